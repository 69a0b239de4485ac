"""Operator 3, quality rules [native]: per-document rules, failure rates by host, and the hosts' verdicts joined back.

All in built-in expressions. Rules look at one document. A host's failure rate is shrunk towards the
rates of all hosts by a beta prior whose two parameters are fitted to them (method of moments), so a
host with three documents isn't judged on three documents. A host whose shrunk rate is above
`host_limit` is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null texts have no words.

    Repeated windows: hashes of all five-word windows are compared by one hash set; only a text with
    a repeat sorts (hash, place) to find which windows repeat, and counts the words that they cover.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    df = docs.select(
        "*",
        F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: x != "").alias("_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.select("*", F.size("_words").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_words", lambda x: F.xxhash64(x)).alias("_h"))
    last = F.col("n_words") - WINDOW + 1
    windows = F.when(last > 0, F.transform(F.sequence(F.lit(0), (last - 1).cast("int")), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    df = df.drop("_lines").withColumn("_w", windows)
    repeats = F.size(F.array_distinct("_w")) < F.size("_w")
    pairs = F.when(repeats, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.drop("_words", "_h").withColumn("_p", pairs).drop("_w")
    same = lambda i, x: F.coalesce(F.get("_p", i)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_p", lambda x, i: ((i > 0) & same(i - 1, x)) | same(i + 1, x)), lambda x: x["i"]))
    df = df.withColumn("_i", places).drop("_p")
    covered = F.aggregate(F.transform("_i", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_i", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_i")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def host_rates(stats: DataFrame, host_col: str = "host", failed_col: str = "base_failed") -> DataFrame:
    """Per host: documents, failures and the shrunk rate (failures + a) / (documents + a + b).

    a and b: mean m and variance v of the hosts' rates, m (1 - m) / v - 1 = a + b, held between 1 and
    1000 so that equal rates or a single host leave a usable prior. A null host is a host of its own.
    """
    hosts = stats.groupBy(host_col).agg(F.count("*").alias("docs"), F.sum(F.col(failed_col).cast("long")).alias("failures"))
    rates = hosts.select((F.col("failures") / F.col("docs")).alias("r"))
    m, v = F.avg("r"), F.coalesce(F.var_samp("r"), F.lit(0.0))
    prior = rates.agg(m.alias("m"), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(F.try_divide(m * (1 - m), v) - 1, F.lit(1000.0)))).alias("strength"))
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    return joined.select(host_col, "docs", "failures", ((F.col("failures") + F.col("m") * F.col("strength")) / (F.col("docs") + F.col("strength"))).alias("rate"))


def host_of(docs: DataFrame, host_col: str) -> Column:
    """The host of a row: of a URL its host name, of anything else the value itself."""
    value = F.col(f"`{host_col}`").cast("string")
    return F.coalesce(F.when(value.contains("://"), F.lower(F.try_parse_url(value, F.lit("HOST")))), value)


def quality(docs: DataFrame, host_limit: float = 0.6, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, the base statistics, base_failed, host_rate and kept.

    The narrow statistics are stored once; they are then summed by host (combined before the shuffle)
    and joined with the hosts' verdicts. The join is Catalyst's: broadcast only while the measured
    size of the verdicts is below spark.sql.autoBroadcastJoinThreshold, else a sort-merge join whose
    hot hosts AQE splits. Null texts have no words and fail; ties and repeated rows are counted each.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), host_of(docs, host_col).alias("host"), F.col(f"`{text_col}`").alias("_text"))
    stats = stored(with_stats(rows, "_text").drop("_text"), "quality")
    rates = stored(host_rates(stats).select("host", F.col("rate").alias("host_rate")), "hosts")
    out = stats.join(rates, stats["host"].eqNullSafe(rates["host"]), "left").drop(rates["host"])
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= host_limit)).alias("kept"), "host_rate",
    )


def keep_documents(docs: DataFrame, host_limit: float = 0.6, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that pass, with their own columns: texts are judged once, and rejected hosts are anti-joined.

    The judged rows are stored, so that the hosts' rates read two narrow columns of them and no text is judged twice;
    only the rejected hosts are joined, stored first so that their size is known to the planner. Null, empty and
    blank texts have no words and go; repeated rows are judged alike; a null host is a host of its own; of
    an empty table nothing stays. Columns of docs are kept in a struct, so their names may be any.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), host_of(docs, host_col).alias("host"), F.col(f"`{text_col}`").alias("_text"))
    judged = stored(with_stats(rows, "_text").select("_row", "host", "base_failed"), "judged")
    bad = stored(host_rates(judged.select("host", "base_failed")).where(F.col("rate") > host_limit).select(F.col("host").alias("_bad")), "rejected-hosts")
    kept = judged.where(~F.col("base_failed")).select("_row", "host")
    return kept.join(bad, F.col("host").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")
