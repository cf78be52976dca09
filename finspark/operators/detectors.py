"""Deterministic detectors over sentences. Each proves what it reports or keeps silent.

All take sentences (document_id, n, sentence) and give (document_id, n, detector, proof, status). A
sentence that quotes, corrects or denies is demoted to review. Null and empty texts give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TALKS_ABOUT = "更正|勘误|例如|并非|应为|误写|corrected|for example"


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key as document_id, n, sentence; one row per sentence, terminators kept."""
    marked = F.regexp_replace(F.col(text), r"([。！？!?\n]+)", "$1\u0001")
    s = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("document_id"), F.posexplode(F.split(marked, "\u0001")).alias("n", "sentence"))
    return s.where(F.trim("sentence") != "")


def _found(s: DataFrame, name: str, when: Column, proof: Column) -> DataFrame:
    status = F.when(F.col("sentence").rlike(_TALKS_ABOUT), "needs_review").otherwise("confirmed")
    return s.where(F.coalesce(when, F.lit(False))).select("document_id", "n", F.lit(name).alias("detector"), proof.alias("proof"), status.alias("status"))


def _part(pattern: str, i: int) -> Column:
    return F.regexp_extract("sentence", pattern, i)


def impossible_dates(s: DataFrame) -> DataFrame:
    p = r"((?:19|20)\d{2})年(\d{1,2})月(\d{1,2})日"
    day = F.concat_ws("-", _part(p, 1), F.lpad(_part(p, 2), 2, "0"), F.lpad(_part(p, 3), 2, "0"))
    return _found(s, "calendar", F.col("sentence").rlike(p) & day.try_cast("date").isNull(), day)


def reversed_ranges(s: DataFrame) -> DataFrame:
    p = r"(\d{1,2})月(\d{1,2})日(?:至|到|-|—)(\d{1,2})月(\d{1,2})日"
    a, b = _part(p, 1).try_cast("int") * 100 + _part(p, 2).try_cast("int"), _part(p, 3).try_cast("int") * 100 + _part(p, 4).try_cast("int")
    legal = (a % 100).between(1, 31) & (b % 100).between(1, 31) & a.between(101, 1231) & b.between(101, 1231)
    return _found(s, "reversed_date_range", F.col("sentence").rlike(p) & legal & (a > b) & ~F.col("sentence").rlike("次年|翌年|跨年"), _part(p, 0))


def backward_years(s: DataFrame) -> DataFrame:
    p = r"((?:19|20)\d{2})年?(?:至|到|-|—)((?:19|20)\d{2})年"
    return _found(s, "backward_years", F.col("sentence").rlike(p) & (_part(p, 1).try_cast("int") > _part(p, 2).try_cast("int")), _part(p, 0))


def wrong_equations(s: DataFrame) -> DataFrame:
    """a op b = c with one unit throughout, compared at the precision c is printed with, half up."""
    p = r"(?<![\d.,+\-×*÷/=])(\d{1,9}(?:\.\d{1,4})?)\s*([+\-×*])\s*(\d{1,9}(?:\.\d{1,4})?)\s*=\s*(\d{1,12}(?:\.\d{1,4})?)(?![\d.,]|\s*[+\-×*÷/=])"
    num = lambda i: _part(p, i).try_cast("decimal(18,4)")
    value = F.when(_part(p, 2) == "+", num(1) + num(3)).when(_part(p, 2) == "-", num(1) - num(3)).otherwise(num(1) * num(3)).cast("decimal(34,8)")
    scale = F.length(F.regexp_extract(_part(p, 4), r"\.(\d+)", 1))
    ladder = F.round(value, 0)
    for d in range(1, 5):
        ladder = F.when(scale == d, F.round(value, d)).otherwise(ladder)
    return _found(s, "arithmetic", F.col("sentence").rlike(p) & ~F.col("sentence").rlike("约|大约|近|左右|approximately") & (ladder != num(4)), _part(p, 0))


def repeated_phrases(s: DataFrame) -> DataFrame:
    p = r"([一-鿿]{2,8})\1"
    return _found(s, "redundant_phrase", F.col("sentence").rlike(p), _part(p, 0))


def repeated_sentences(s: DataFrame) -> DataFrame:
    """A sentence right after an identical one; of a run of copies every second is reported."""
    w = Window.partitionBy("document_id").orderBy("n")
    t = s.withColumn("plain", F.trim("sentence"))
    t = t.withColumn("new", (F.coalesce(F.lag("plain").over(w), F.lit("")) != F.col("plain")).cast("int")).withColumn("run", F.sum("new").over(w))
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("document_id", "run").orderBy("n")))
    return _found(t, "redundant_sentence", (F.col("at") % 2 == 0) & F.length("plain").between(8, 200), F.col("plain"))


def empty_brackets(s: DataFrame) -> DataFrame:
    p = r"[(（]\s*[)）]|“\s*”|《\s*》"
    return _found(s, "empty_placeholder", F.col("sentence").rlike(p), _part(p, 0))


def hanging_marks(s: DataFrame) -> DataFrame:
    p = r"[，、,]\s*[。；;]"
    return _found(s, "suspended_punctuation", F.col("sentence").rlike(p), _part(p, 0))


def numberless_units(s: DataFrame) -> DataFrame:
    p = r"(?:增长|下降|上升|减少|同比|环比)\s*[%％]"
    return _found(s, "percent_gap", F.col("sentence").rlike(p), _part(p, 0))


def rank_beyond_total(s: DataFrame) -> DataFrame:
    p = r"(\d{1,4})家[^。]{0,12}?第(\d{1,4})[名位]"
    return _found(s, "rank_within_total", F.col("sentence").rlike(p) & (_part(p, 2).try_cast("int") > _part(p, 1).try_cast("int")), _part(p, 0))


def uneven_lists(s: DataFrame) -> DataFrame:
    """"A、B、C分别为1、2": as many objects as values, or it is reported."""
    p = r"([一-鿿A-Za-z]{1,10}(?:、[一-鿿A-Za-z]{1,10}){0,6}(?:[和及与][一-鿿A-Za-z]{1,10})?)分别(?:为|是|达到)((?:-?\d[\d.,]*[%％万亿元]*)(?:(?:、|和|及)-?\d[\d.,]*[%％万亿元]*)*)"
    count = lambda c: F.size(F.split(c, "[、和及与]"))
    return _found(s, "enumeration", F.col("sentence").rlike(p) & (count(_part(p, 1)) >= 2) & (count(_part(p, 1)) != count(_part(p, 2))), _part(p, 0))


def short_codes(s: DataFrame) -> DataFrame:
    p = r"(?:股份|集团|公司|科技)[(（](\d{3,5})[)）]"
    return _found(s, "stock_code_gap", F.col("sentence").rlike(p), _part(p, 0))


def money_on_ratio(s: DataFrame) -> DataFrame:
    p = r"(?:毛利率|净利率|负债率|占比)(?:为|达到|约)\s*\d[\d.,]*\s*(?:万元|亿元|元)"
    return _found(s, "unit_dimension", F.col("sentence").rlike(p), _part(p, 0))


DETECTORS = (
    impossible_dates, reversed_ranges, backward_years, wrong_equations, repeated_phrases, repeated_sentences, empty_brackets, hanging_marks,
    numberless_units, rank_beyond_total, uneven_lists, short_codes, money_on_ratio,
)


def detect(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Findings of all detectors, one row per document, sentence and detector."""
    s, out = sentences(texts, key, text), None
    for d in DETECTORS:
        out = d(s) if out is None else out.unionByName(d(s))
    return out
