"""Operator 3: line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line with a word is dropped if an earlier line of the corpus is equal to it or, where both are long enough, within
one edit of it. Lines within one edit share a variant: equal after deleting one character at the same
place (a substitution), or one of them equals the other without one character. Every
line emits its variants as hashed keys, equal keys are joined, the earliest line of a key is the
witness, and the one edit is verified at the place that the variant names, in time linear in the line.

Lines are ordered by document, then by a hash of the document's text (so rows that share an id and differ in text
are documents of their own), then by place.

A line has as many variants as characters, so cheap steps come first, which lose no pair: equal
lines are merged, and lines go on only if they agree with another line of nearly equal
length outside one block: one edit leaves one of two halves, and then 15 of 16 blocks, as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, written
from tessera.llm.quality import BLANKS, let
from tessera.operators.ordered import numbered

#: Shorter lines are dropped for equal ones only: in a few characters one edit makes another word ("Part 1", "Part 2").
MIN_CHARS = 20
#: Into so many blocks lines are cut, first all lines, then those that go on.
BLOCKS = (2, 16)
GAP, CUT, WHOLE = 0, 1, 2


def documents_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text): `row` tells documents with one id apart by their texts."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text")).where("text is not null")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    """Ids may be null."""
    return a["doc"].eqNullSafe(b["doc"]) & (a["row"] == b["row"])


def block_keys(line: Column, n: Column, blocks: int) -> Column:
    """Keys of what one edit leaves of a line: for the lengths n and n - 1 of the shorter line of a pair, and each of
    its blocks that may hold the edit, all before the block from the front, all after it from the back."""

    def key(shorter: Column, b: int) -> Column:
        before, end = F.floor(shorter * b / blocks).cast("int"), F.floor(shorter * (b + 1) / blocks).cast("int")
        rest = shorter - end
        return F.xxhash64(F.lit(b), shorter, F.substring(line, F.lit(1), before), F.substring(line, n - rest + 1, rest))

    return F.array_distinct(F.array(*[key(m, b) for m in (n, n - 1) for b in range(blocks)]))


def sharing(keyed: DataFrame) -> DataFrame:
    """(first) of the lines (columns first, keys) that share a key with another line."""
    spread = keyed.select("first", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    return spread.join(shared, "key", "left_semi").select("first").distinct()


def variants(lines: DataFrame) -> DataFrame:
    """(first, kind, at, key): the deletion neighbourhood of each line (columns first, line, n).

    WHOLE is the line itself, CUT the line without the character at place `at`, keyed by length and content; GAP the same,
    keyed by the place of the character as well. Content is hashed as the exclusive-or of 64-bit hashes of (character,
    place), so running values give all of a line's keys at once. Whole lines are dealt before they are taken apart, to as
    many tasks as their characters need.
    """
    total = lines.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(total >> 18, 2000 + (total >> 22)))
    chars = lines.repartition(tasks, "first").select("first", "n", F.posexplode(F.split("line", "")).alias("at", "char")).where("at < n")
    inside = Window.partitionBy("first").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own, moved = F.xxhash64("char", "at"), F.xxhash64(F.col("char"), F.col("at") - 1)
    # What follows a place is the whole less what has run: both windows share one sort.
    whole = Window.partitionBy("first")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = chars.select(
        "first", "n", "at",
        F.coalesce(F.bit_xor(own).over(before), F.lit(0)).bitwiseXOR(F.bit_xor(moved).over(whole).bitwiseXOR(F.bit_xor(moved).over(upto))).alias("rest"),
        F.bit_xor(own).over(whole).alias("all"),
    )
    cut, whole = F.xxhash64(F.col("n") - 1, F.col("rest")), F.xxhash64("n", "all")
    gap = F.xxhash64("n", "at", "rest")
    kinds = F.array(*[F.struct(F.lit(kind).cast("byte").alias("kind"), key.alias("key")) for kind, key in ((GAP, gap), (CUT, cut), (WHOLE, F.when(F.col("at") == 0, whole)))])
    return rows.select("first", "at", F.explode(F.filter(kinds, lambda k: k["key"].isNotNull())).alias("v")).select("first", "at", "v.*")


def witnesses(keyed: DataFrame) -> DataFrame:
    """(first, witness, kind, at): for each line the earliest line that shares a variant and comes before it, and
    where the edit is.

    Only minima of each key are kept, so a key that very many lines share makes no pairs: all lines of a gap are
    within one edit of each other; a cut is within one edit of the whole line it equals.
    """
    place = F.struct("first", "at")
    least = [F.min(F.when(F.col("kind") == kind, place)).alias(name) for kind, name in ((GAP, "gap"), (CUT, "cut"), (WHOLE, "whole"))]
    by_key = keyed.groupBy("key").agg(*least, F.count("*").alias("members")).where("members > 1").drop("members")
    other = F.when(F.col("kind") == GAP, F.col("gap")).when(F.col("kind") == CUT, F.col("whole")).otherwise(F.col("cut"))
    found = keyed.join(by_key, "key").withColumn("other", other).where("other.first < first")
    where = F.struct("kind", F.when(F.col("kind") == WHOLE, F.col("other.at")).otherwise(F.col("at")).alias("at"))
    return found.groupBy("first", F.col("other.first").alias("witness")).agg(F.min(where).alias("edit")).select("first", "witness", "edit.*")


def one_edit(line: Column, earlier: Column, kind: Column, at: Column) -> Column:
    """Whether the lines agree before and after the one edit at a place: linear, whatever the length."""

    def agree(a: Column, b: Column) -> Column:
        ends = F.substring(line, at + a, F.length(line)) == F.substring(earlier, at + b, F.length(earlier))
        return ends & (F.substring(line, F.lit(1), at) == F.substring(earlier, F.lit(1), at))

    two, one = F.lit(2), F.lit(1)
    return F.when(kind == GAP, agree(two, two)).when(kind == CUT, agree(two, one)).otherwise(agree(one, two))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, line_no) of the lines to drop."""
    docs = documents_of(df, id_col, text_col)
    line, first = F.col("line"), F.struct("doc", "row", "line_no")
    lines = docs.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.ltrim("line", F.lit(BLANKS)) != "")
    n = F.length("line")
    keys = F.when(n >= min_chars, block_keys(line, n, BLOCKS[0])).otherwise(F.array().cast("array<bigint>"))
    narrow = lines.select("doc", "row", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"), keys.alias("keys"))
    distinct = written(
        narrow.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "lines"
    )
    near = written(sharing(distinct).select("first.*").groupBy("doc", "row").agg(F.collect_set("line_no").alias("wanted")), "near-lines")
    some = docs.join(near, same_document(docs, near)).select(docs["doc"], docs["row"], "text", "wanted")
    chosen = let(F.split("text", "\n", -1), lambda all_: F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.get(all_, i).alias("line"))))
    texts = some.select("doc", "row", F.explode(chosen).alias("v")).select(F.struct("doc", "row", "v.line_no").alias("first"), "v.line")
    # From here on lines are known by their number in the order.
    once = texts.dropDuplicates(["first"]).select("first.*", "line", F.length("line").alias("n"))
    texts = numbered(once, ["doc", "row", "line_no"]).drop("total").withColumnRenamed("position", "first")
    close = sharing(texts.select("first", block_keys(F.col("line"), F.col("n"), BLOCKS[1]).alias("keys")))
    texts = written(texts.join(close, "first", "left_semi"), "close-lines")
    found = witnesses(variants(texts))
    proved = (
        found.join(texts.select("first", "line"), "first")
        .join(texts.select(F.col("first").alias("witness"), F.col("line").alias("earlier")), "witness")
        .where(one_edit(F.col("line"), F.col("earlier"), F.col("kind"), F.col("at")))
        .select("first").distinct().join(texts.select("first", "doc", "row", "line_no"), "first")
    )
    # All copies but the first go, and the first too if an earlier line is within one edit.
    copies = distinct.where("copies > 1").select("k1", "k2", F.col("first").alias("kept"), "copies")
    later = salted_join(narrow.drop("keys"), copies, ["k1", "k2"], "copies").where(first > F.col("kept")).select("doc", "row", "line_no")
    return later.union(proved.select("doc", "row", "line_no"))


def without_lines(text: Column, dropped: Column) -> Column:
    """A text without the lines of the given sorted numbers: the runs of lines between them, joined."""

    def rest(lines: Column) -> Column:
        marks = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
        k = F.size(marks)
        runs = F.zip_with(F.slice(marks, 1, k - 1), F.slice(marks, 2, k - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
        return F.array_join(F.flatten(runs), "\n")

    return let(F.split(text, "\n", -1), rest)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df's rows with the text rid of lines that an earlier line repeats, and n_lines, n_dropped (longs).

    Lines are split at \\n. A line without a word always stays; one of at least `min_chars` characters goes if an earlier
    one of as many is within one edit, a shorter one only if an earlier one is equal. A null text stays null, with 0
    lines. Rows that share an id and differ in text are documents of their own; rows equal in both are one document and
    all get its result. A null id comes before all others. An empty table gives none. Columns of df with the name of an
    added one are replaced; no other name can clash.
    """
    gone = dropped_lines(df, id_col, text_col, min_chars)
    by_doc = gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    text = F.col(text_col).cast("string")
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    rows = df.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"), rest.alias("rest"))
    found = rows.join(by_doc, same_document(rows, by_doc), "left").select("text", "rest", "drop")
    cleaned = F.when(F.col("drop").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("drop")))
    return found.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in df.columns if c == text_col or c in others],
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def deduplicated_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df's columns, with cleaned texts; documents that lose lines and have no word left go."""
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = dedup_lines(inner, "id", "text", min_chars).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col(f"whole.`{c}`") for c in df.columns])
