"""Line dedup with a log-template tree (operator 8).

A line is its tokens; tokens with a digit are variable fields. The tree has a fixed depth: the number of tokens, then
the first ``LEAD`` tokens (all of a shorter line). In a leaf, tokens that often stand at a position are constants there and all others are variable;
lines with the same constants share a template if these are at least ``ALIKE`` percent of their tokens, so a leaf holds any
number of templates. A template recurs if at least ``documents`` different texts have a line of it: a copied text counts once, and so do the
repeated lines of one text. Lines of recurring templates are dropped everywhere. A line that recurs by itself is a template without variable fields.

A document of which less than a tenth would be left is no carrier of boilerplate but a copy, or a near copy, of other documents: it is
kept whole, for the operators that deal with copies.

The texts are masked once, in a written table that has a row per line with hashes only: (text, line number, line, leaf). What recurs is
counted on it by partial aggregates of distinct pairs, so a line or a text with a third of all rows is one row per task. Texts of lines
move only for leaves in which several lines could share a template. Everything is DataFrame code.

Defined cases: null text stays null, with no lines; blank lines are kept; lines of any length count; a text without blanks is one token; repeated rows
are treated alike; an empty table gives no rows; ``drop_boilerplate`` keeps further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import BLANKS, packed, unpacked
from barloom.session import materialize

LEAD = 3
ALIKE = 80
DOCUMENTS = 10
LEAST_LEFT = 10  # percent of a text's characters


def _masked(text: Column) -> Column:
    """The text with fields masked, blanks single and lines' ends trimmed. The pattern only starts where a token does, and never goes back:
    it is linear in tokens of any length. Its blanks are those of ``BLANKS``; spelt as ranges they take several times as long."""
    fields = F.regexp_replace(text, "(?<!\\S)[\\S&&\\D]*+\\d\\S*+", "<*>")
    return F.regexp_replace(fields, "[ \\t\\x0B-\\r]++", " ")


def _masked_lines(text: Column) -> Column:
    return F.transform(F.split(_masked(text), "\n"), lambda x: F.trim(x))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", LEAD))


def line_table(docs: DataFrame) -> DataFrame:
    """(t, i, h, leaf, n) of every line that is not blank: hash of the text, line number, hash of the masked line, leaf and number of tokens."""
    lines = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("t"), _masked_lines(F.col("text")).alias("l"))
    rows = lines.select("t", F.posexplode_outer("l").alias("i", "line")).where("line <> ''")
    return rows.select("t", "i", F.xxhash64("line").alias("h"), _leaf(F.col("line")).alias("leaf"), _tokens(F.col("line")).alias("n"))


def recurring_lines(docs: DataFrame, lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h,) hashes of the masked lines whose template recurs; ``lines`` is the written line table of ``docs``."""
    counts = materialize(lines.select("h", "leaf", "n", "t").distinct().groupBy("h", "leaf", "n").agg(F.count(F.lit(1)).alias("c")), "line-counts")
    alone = counts.where(F.col("c") >= documents).select("h")
    # leaves in which lines that do not recur by themselves could do so together
    mixed = materialize(counts.where((F.col("c") < documents) & (F.col("n") > 1)).groupBy("leaf").agg(F.sum("c").alias("leaf_c"), F.count(F.lit(1)).alias("k")).where(
        (F.col("leaf_c") >= documents) & (F.col("k") > 1)).select("leaf"), "leaves")
    wanted = counts.where(F.col("c") < documents).join(mixed, "leaf", "left_semi")
    carriers = lines.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t"))
    source = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("t"), "text").join(carriers.select("t").distinct(), "t", "left_semi")
    texts = source.select(F.explode_outer(F.array_distinct(_masked_lines(F.col("text")))).alias("line")).where("line <> ''").select(F.xxhash64("line").alias("h"), "line")
    texts = texts.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    tokens = materialize(wanted.join(texts, "h").select("h", "leaf", "n", "c", F.posexplode(F.split("line", " ")).alias("pos", "token")), "line-tokens")
    constants = tokens.groupBy("leaf", "pos", "token").agg(F.sum("c").alias("w")).where(F.col("w") >= documents).drop("w")
    kept = tokens.join(constants, ["leaf", "pos", "token"]).groupBy("h", "leaf", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("k"))
    like = materialize(kept.where(100 * F.size("k") >= ALIKE * F.col("n")).select("h", F.xxhash64("leaf", "k").alias("template")), "line-templates")
    general = lines.join(like, "h").select("template", "t").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= documents)
    return materialize(alone.unionByName(like.join(general, "template", "left_semi").select("h")), "recurring-lines")


def _kept(docs: DataFrame, documents: int) -> DataFrame:
    """(row, text): the given rows as structs and what is left of their texts."""
    lines = materialize(line_table(docs), "lines")
    gone = lines.join(recurring_lines(docs, lines, documents), "h").groupBy("t").agg(F.collect_set("i").alias("gone"))
    rows = packed(docs, "text", F.xxhash64("text").alias("t")).join(gone, "t", "left")
    raw = F.split("text", "\n")
    # set difference of line numbers: linear in the lines
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), "gone"), lambda i: raw[i]), "\n")
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    copied = 100 * F.length("left") < LEAST_LEFT * F.length("text")
    return rows.select("row", F.when(F.col("left").isNull() | copied, F.col("text")).otherwise(F.col("left")).alias("text"))


def drop_boilerplate(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The documents without the lines of recurring templates."""
    return unpacked(_kept(docs, documents), docs.columns, text=F.col("text"))


def digests(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (not blank), n_dropped, kept_chars, kept_sha256 of every document."""
    def lines(c: Column) -> Column:
        return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")

    was, text = F.col("row.text"), F.coalesce("text", F.lit(""))
    return _kept(docs.select("doc_id", "text"), documents).select(
        "row.doc_id", lines(was).alias("n_lines"), (lines(was) - lines(F.col("text"))).alias("n_dropped"),
        F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def oracle_sql(documents: int = DOCUMENTS) -> str:
    """The digests with lines and texts as strings instead of hashes."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, text, i, string_split(text, chr(10))[i] AS raw
      FROM (SELECT rid, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
m AS (SELECT rid, text, i, raw, trim(regexp_replace(regexp_replace(raw, '[^ \\t-\\r]*[0-9][^ \\t-\\r]*', '<*>', 'g'), '[ \\t-\\r]+', ' ', 'g'), ' ') AS line FROM l),
c AS (SELECT line, string_split(line, ' ') AS ts, len(string_split(line, ' ')) AS n,
             len(string_split(line, ' ')) || ' ' || array_to_string(string_split(line, ' ')[1:{LEAD}], ' ') AS leaf, count(DISTINCT text) AS c
      FROM m WHERE line <> '' GROUP BY line),
f AS (SELECT leaf FROM c WHERE c < {documents} AND n > 1 GROUP BY leaf HAVING sum(c) >= {documents} AND count(*) > 1),
t AS (SELECT line, leaf, n, c, pos, ts[pos] AS token FROM (SELECT c.*, unnest(range(1, n + 1)) AS pos FROM c JOIN f USING (leaf) WHERE c < {documents})),
k AS (SELECT leaf, pos, token FROM t GROUP BY leaf, pos, token HAVING sum(c) >= {documents}),
a AS (SELECT line, leaf, list((pos, token) ORDER BY pos) AS template FROM t JOIN k USING (leaf, pos, token) GROUP BY line, leaf, n HAVING 100 * count(*) >= {ALIKE} * n),
g AS (SELECT leaf, template FROM a JOIN (SELECT DISTINCT line, text FROM m) USING (line) GROUP BY leaf, template HAVING count(DISTINCT text) >= {documents}),
gone AS (SELECT line FROM c WHERE c >= {documents} UNION SELECT line FROM a JOIN g USING (leaf, template)),
r AS (SELECT rid, any_value(text) AS text, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (gone.line IS NULL), '') AS part
      FROM m LEFT JOIN gone ON m.line = gone.line GROUP BY rid),
s AS (SELECT rid, CASE WHEN 100 * length(part) < {LEAST_LEFT} * length(text) THEN text ELSE part END AS kept FROM r),
z AS (SELECT doc_id, text, kept, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
             len(list_filter(string_split(kept, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_kept FROM d JOIN s USING (rid))
SELECT doc_id, n_lines, n_lines - n_kept AS n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM z"""
