"""Registered queries on exact search, metadata and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import vectors as V
from ..operators import topk
from . import workload as W


def _out(df):
    return df.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def exact_topk(spark, d):
    return _out(topk.exact_top_k(W.vectors(spark, d), W.queries(spark, d), W.TOP))


def exact_topk_prefix(spark, d):
    """The first half of the ids."""
    n = W.vectors(spark, d).count()
    return _out(topk.exact_top_k(W.vectors(spark, d), W.queries(spark, d), W.TOP, where=F.col("id") < n // 2))


def _allowed(spark, d):
    return W.vectors(spark, d).where("id % 3 = 0").select("id")


def exact_topk_allowed(spark, d):
    return _out(topk.exact_top_k(W.vectors(spark, d), W.queries(spark, d), W.TOP, allowed=_allowed(spark, d)))


def _values(spark, d):
    """The values of a field that an expression matches."""
    return lambda field, pattern: M.matching(W.metadata(spark, d), field, pattern)


def _filtered(conditions, allowed=False):
    def run(spark, d):
        m = W.metadata(spark, d)
        return _out(topk.exact_top_k(m, W.queries(spark, d), W.TOP, where=M.where(conditions, _values(spark, d)), allowed=_allowed(spark, d) if allowed else None))

    return run


def _sql(where, ctes=""):
    return W.topk_sql("meta", where, ctes=W.META + (", " + ctes if ctes else ""))


def filter_float_range(spark, d):
    """``part`` prices as floats with two decimals, rounded half to even."""
    p = W.read(spark, d, "part").select(F.col("p_partkey").alias("id"), M.number_column(F.col("p_retailprice"), 2).alias("price"))
    v = W.vectors(spark, d).join(p, "id").withColumns({"meta": F.create_map(F.lit("price"), F.array(F.col("price").cast("string"))), "nums": F.create_map(F.lit("price"), F.array("price"))})
    return _out(topk.exact_top_k(v, W.queries(spark, d), W.TOP, where=M.where({"price": ("range", 940.0, 910.25)}, specs={"price": M.FloatSpec(2)})))


def filter_date_range(spark, d):
    """Order dates as yyyymmdd."""
    import datetime as dt

    o = W.read(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("id"), M.date_column(F.col("o_orderdate")).alias("day"))
    v = W.vectors(spark, d).join(o, "id").withColumns({"meta": F.create_map(F.lit("day"), F.array(F.col("day").cast("string"))), "nums": F.create_map(F.lit("day"), F.array("day"))})
    return _out(topk.exact_top_k(v, W.queries(spark, d), W.TOP, where=M.where({"day": ("range", dt.date(1993, 1, 1), dt.date(1996, 6, 30))})))


def filter_exact_shortcut(spark, d):
    """At most 4096 eligible ids are scored exhaustively: a bounded count decides on the driver."""
    eligible = W.metadata(spark, d).where(M.where({"lang": "de"}))
    few = eligible.select("id").limit(4097).count() <= 4096
    out = _out(topk.exact_top_k(eligible, W.queries(spark, d), W.TOP))
    return out.withColumn("plan", F.lit("exact" if few else "cells"))


def metadata_encode_keys(spark, d):
    return W.metadata(spark, d).select("id", F.explode(M.key_column(F.col("meta"), F.col("nums"))).alias("key"))


def metadata_keys_dictionary(spark, d):
    return metadata_encode_keys(spark, d).select("key").distinct()


def filter_bitmap_algebra(spark, d):
    """Cardinalities of OR, AND and AND NOT of id sets, as bitmaps by bucket."""
    sets = W.metadata(spark, d).select("id", (F.col("lang") == "de").alias("a"), (F.col("n_chars") > 1000).alias("b"))
    bucket, bit = F.expr("bitmap_bucket_number(id + 1)"), F.expr("bitmap_bit_position(id + 1)")
    maps = sets.where("a or b").groupBy(bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.when(F.col("a"), bit)).alias("a"), F.bitmap_construct_agg(F.when(F.col("b"), bit)).alias("b"), F.bitmap_construct_agg(F.when(F.col("a") | F.col("b"), bit)).alias("o")
    )
    n = maps.agg(*(F.sum(F.bitmap_count(c)).alias(c) for c in "abo"))
    return n.select(F.col("o").alias("n_or"), (F.col("a") + F.col("b") - F.col("o")).alias("n_and"), (F.col("o") - F.col("b")).alias("n_andnot"))


def vec_reject_invalid(spark, d):
    """Validation: which of a vector's spoilt forms are refused."""
    v = W.vectors(spark, d)
    forms = {"as_is": F.col("v"), "short": F.slice("v", 1, 10), "nan": F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x)), "zero": F.transform("v", lambda x: x * 0)}
    return v.select("id", *(V.is_valid(x, W.DIM).alias(n) for n, x in forms.items()))


_KEYS = """mk AS (
SELECT id, unnest(['lang=' || lang, 'lang:*', 'source=' || source, 'source:*', 'both=' || lang, 'both=' || source, 'both:*', 'rank=' || n_chars, 'rank.b3=' || n_chars // 1000, 'rank.b6=' || n_chars // 1000000, 'rank.b9=' || n_chars // 1000000000, 'rank:*']) AS key FROM meta WHERE lang IS NOT NULL
UNION ALL SELECT id, unnest([CASE WHEN toxic = 1 THEN 'toxic=true' ELSE 'toxic=false' END, 'toxic:*']) FROM meta WHERE toxic IS NOT NULL)"""

QUERIES = {
    "exact_topk": (exact_topk, W.topk_sql("unit")),
    "exact_topk_prefix": (exact_topk_prefix, W.topk_sql("unit", "x.id < (SELECT count(*) // 2 FROM embeddings)")),
    "exact_topk_allowed": (exact_topk_allowed, W.topk_sql("unit", "x.id % 3 = 0")),
    "filter_eq": (_filtered({"lang": "de"}), _sql("lang = 'de'")),
    "filter_in": (_filtered({"lang": ["de", "fr"]}), _sql("lang IN ('de', 'fr')")),
    "filter_in_empty": (_filtered({"lang": []}), _sql("false")),
    "filter_range": (_filtered({"rank": ("range", 500, 3000)}), _sql("n_chars BETWEEN 500 AND 3000")),
    "filter_range_swapped": (_filtered({"rank": ("range", 3000, 500)}), _sql("n_chars BETWEEN 500 AND 3000")),
    "filter_number_as_string": (_filtered({"rank": [str(n) for n in range(400, 700)]}), _sql("n_chars BETWEEN 400 AND 699")),
    "filter_exists": (_filtered({"toxic": ("exists",)}), _sql("toxic IS NOT NULL")),
    "filter_regex": (_filtered({"source": ("re", "^src1[0-5]?$")}), _sql("regexp_matches(source, '^src1[0-5]?$')")),
    "filter_regex_none": (_filtered({"source": ("re", "^nothing$")}), _sql("false")),
    "filter_bool": (_filtered({"toxic": True}), _sql("toxic = 1")),
    "filter_multivalue": (_filtered({"both": ["src3", "fr"]}), _sql("lang = 'fr' OR source = 'src3'")),
    "filter_and": (_filtered({"lang": "en", "rank": ("range", 100, 2500), "source": ["src1", "src2", "src3", "src4"]}), _sql("lang = 'en' AND n_chars BETWEEN 100 AND 2500 AND source IN ('src1', 'src2', 'src3', 'src4')")),
    "filter_and_allowed": (_filtered({"lang": "en"}, True), _sql("lang = 'en' AND x.id % 3 = 0")),
    "filter_float_range": (filter_float_range, W.topk_sql("pv", "price BETWEEN 91025 AND 94000", ctes="pv AS MATERIALIZED (SELECT u.id, u.v, CAST(round_even(p_retailprice * 100.0::DOUBLE, 0) AS BIGINT) AS price FROM unit u JOIN part ON p_partkey = u.id)")),
    "filter_date_range": (filter_date_range, W.topk_sql("ov", "day BETWEEN 19930101 AND 19960630", ctes="ov AS MATERIALIZED (SELECT u.id, u.v, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS day FROM unit u JOIN orders ON o_orderkey - 1 = u.id)")),
    "filter_exact_shortcut": (filter_exact_shortcut, "SELECT *, CASE WHEN (SELECT count(*) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE lang = 'de') <= 4096 THEN 'exact' ELSE 'cells' END AS plan FROM (" + _sql("lang = 'de'") + ")"),
    "metadata_encode_keys": (metadata_encode_keys, f"WITH {W.BASE}, {W.META}, {_KEYS} SELECT id, key FROM mk"),
    "metadata_keys_dictionary": (metadata_keys_dictionary, f"WITH {W.BASE}, {W.META}, {_KEYS} SELECT DISTINCT key FROM mk"),
    "filter_bitmap_algebra": (filter_bitmap_algebra, f"WITH {W.BASE}, {W.META} SELECT count(*) FILTER (lang = 'de' OR n_chars > 1000) AS n_or, count(*) FILTER (lang = 'de' AND n_chars > 1000) AS n_and, count(*) FILTER (lang = 'de' AND NOT n_chars > 1000) AS n_andnot FROM meta"),
    "vec_reject_invalid": (vec_reject_invalid, f"WITH vec AS ({W.VEC}) SELECT id, true AS as_is, false AS short, NOT list_bool_or(list_transform(v, lambda x: x > 0.2)) AS nan, false AS zero FROM vec"),
}
