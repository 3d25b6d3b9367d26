"""Removal of repeated lines, also such as differ in a few characters: a segment-partition edit join in SQL functions.

Lines are what line feeds separate, trimmed of white space. A line of at least ``exact`` characters goes when an equal
line stands earlier, by document id and line number, whether or not that one goes too; one of at least ``least``, also
when a line within ``k`` edits (insertions, deletions, replacements of a character) does. Short lines have no segments
to tell them by, but equal ones can be found at any length: ``exact`` is ``least`` unless given.

Equal lines are found by an aggregation over 128-bit hashes; only the first of them is compared with others. A line of
length n is cut into k + 1 segments, of which k edits leave one whole: its hash with n and the segment's number is an
index key. A line probes the keys of lengths n - k to n with its substrings at those places where a segment can lie if
the edits left and right of it are to fit in k. With one edit, the other half is cut again and has a whole quarter, so
keys are longer by it: halves alone are common among the many variants of a line. Lines with a key in common are
candidates. Keys of more than ``HOT`` lines, such as many variants of one line have, make none that way: the part of a
line that such a key leaves out has the edit, so lines one edit apart agree in it after leaving out one character, at one
place if they are equally long. That is a second key, and each line is a candidate only with the first line of its group.
So candidates grow with the lines of a group, not with their square. (Beyond one edit, where queries have none, they are
the pairs of a key.) The texts of candidates are fetched and verified by Hyyrö's banded bit-parallel edit distance: the 2k + 1 cells of a
column that can matter are bits of a number, and a column follows from the one before by additions and bit operations.

Nothing here runs outside of the JVM. Small sides whose size is counted first are broadcast up to a number of rows;
beyond, they are joined by a shuffle.

Defined cases: a null text has no lines and stays null; a document all of whose lines went has an empty text; a null id
neither removes lines nor loses any; rows that repeat an id have lines of equal standing, which do not remove one
another; further columns are kept by remove_lines(), except one named removed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import few, stored

LEAST, EDITS = 25, 1
HOT = 64  # lines of a key that are compared each with each
BLANK = " \t\r\x0b\x0c"
POSITION = "decimal(38,0)"


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def within(a: Column, b: Column, k: int) -> Column:
    """Whether strings a and b, of lengths over k that differ by k at most, are within k edits of each other."""
    width, mask = 2 * k + 1, (1 << (2 * k + 1)) - 1
    bits = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def matches(pattern: Column, c: Column, i: Column) -> Column:
        """Bit d: whether the pattern has the character c at i - k + d."""
        one = [F.when(F.get(pattern, F.when(i - k + d >= 0, i - k + d)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        out = one[0]
        for x in one[1:]:
            out = out + x
        return out

    def step(acc: Column, pm: Column, m: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        d0 = (pm.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask)).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn)

        def after(d: Column) -> Column:
            hp, hn = vn.bitwiseOR(bits(d.bitwiseOR(vp))), d.bitwiseAND(vp)
            low = F.shiftright(d, 1)
            # down the lowest diagonal until it meets the last row, then along that
            at = m - 1 - acc["i"] + k  # bit of the last row in this column
            is_set = lambda x: F.getbit(x, F.least(F.greatest(at, F.lit(0)), F.lit(width - 1)))
            cost = F.when(acc["i"] + k < m, 1 - F.getbit(d, F.lit(width - 1)).cast("int")).otherwise((is_set(hp) - is_set(hn)).cast("int"))
            return F.struct(
                hn.bitwiseOR(bits(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), (acc["cost"] + cost).alias("cost"), (acc["i"] + 1).alias("i"),
            )

        return _let(d0, after)

    def run(pa: Column) -> Column:
        pattern, text = pa["a"], pa["b"]
        m = F.size(pattern)
        masks = F.transform(text, lambda c, i: matches(pattern, c, i))
        start = F.struct(F.lit(mask ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("cost"), F.lit(0).alias("i"))
        return F.aggregate(masks, start, lambda acc, pm: step(acc, pm, m))["cost"] <= k

    return _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, no, line, n) of all lines that count, of n characters; counted once, as each use would walk the line."""
    # one pass in nested lists: a filter over columns would be pushed down and trim and count each line again
    trimmed = F.transform(F.split("text", "\n"), lambda raw: F.btrim(raw, F.lit(BLANK)))
    placed = F.transform(trimmed, lambda line, i: F.struct(i.alias("no"), line.alias("line"), F.char_length(line).alias("n")))
    rows = docs.filter("doc_id is not null").select("doc_id", F.explode(F.filter(placed, lambda x: x["n"] >= least)).alias("x"))
    return rows.select("doc_id", "x.no", "x.line", "x.n")


def _position() -> Column:
    return (F.col("doc_id").cast(POSITION) * F.lit(1 << 32).cast("decimal(11,0)")).cast(POSITION) + F.col("no").cast("decimal(10,0)")


def _keys(k: int, deltas: range, probes: bool) -> Column:
    """Hashes of the segments of a line (index), or of where segments of lines shorter by each delta can lie in it (probes)."""
    n, keys = F.col("n"), []
    for delta in deltas:
        size = n - delta
        for i in range(k + 1):
            start, stop = F.floor(size * i / (k + 1)).cast("int"), F.floor(size * (i + 1) / (k + 1)).cast("int")
            shifts = range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1) if probes else [0]
            keys += [F.xxhash64(size, F.lit(i), F.substring(F.col("line"), start + shift + 1, stop - start)) for shift in shifts]
    return F.array(*keys)


def _parts(delta: int) -> list[tuple[Column, list[Column], Column]]:
    """For one edit, as it lies in either of four quarters: size and number, the rest of the line, and the part with the edit.

    The rest is a half and a quarter, taken from the ends, of a line that is shorter by delta.
    """
    n, line = F.col("n"), F.col("line")
    size = n - delta
    half, quarter, rest = (F.floor(size * i / 4).cast("int") for i in (2, 1, 3))
    first = lambda k: F.substring(line, F.lit(1), k)
    last = lambda k: F.substring(line, n - k + 1, k)
    between = lambda k, z: F.substring(line, k + 1, n - z - k)
    parts = (([first(half), last(quarter)], between(half, quarter)), ([first(rest)], last(n - rest)), ([first(quarter), last(half)], between(quarter, half)), ([last(rest)], first(n - rest)))
    return [(F.struct(size.alias("size"), F.lit(i).alias("i")), known, edited) for i, (known, edited) in enumerate(parts)]


def _halves(delta: int) -> Column:
    """As _keys(), for one edit."""
    return F.array(*(F.xxhash64(at["size"], at["i"], *known) for at, known, _ in _parts(delta)))


def _near_in(single: DataFrame, hot: DataFrame) -> DataFrame:
    """Candidates (h, other) one edit apart among lines (h, at, line, n) that have a key of hot (key): each line with the first of a group."""

    def members(delta: int) -> DataFrame:
        made = F.array(*(F.struct(F.xxhash64(at["size"], at["i"], *known).alias("key"), F.concat(F.lit(f"{i} "), F.concat_ws("\n", *known)).alias("known"), part.alias("part")) for i, (at, known, part) in enumerate(_parts(delta))))
        rows = single.select("h", "at", F.explode(made).alias("x")).select("h", "at", F.col("x.key").alias("key"), "x.known", "x.part")
        return rows.join(few(hot), "key")

    n = F.char_length("part")
    without = lambda i: F.concat(F.substring(F.col("part"), F.lit(1), i), F.substring(F.col("part"), i + 2, n))
    two = lambda *x: F.struct(F.xxhash64(*x).alias("a"), F.xxhash64(F.lit(1), *x, F.lit(2)).alias("b"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(places, lambda i: two(F.lit("replaced"), "key", "known", i, without(i)))
    shorter = F.transform(places, lambda i: two(F.lit("left out"), "key", "known", without(i)))
    own = members(0)
    grouped = own.select("h", "at", F.explode(replaced).alias("group"))
    first = stored(grouped.groupBy("group").agg(F.min_by("h", "at").alias("other"), F.count("*").alias("many")).filter("many > 1").drop("many"), "groups")
    pairs = grouped.join(few(first), "group").filter("h <> other").select("h", "other")
    # a line that is one character longer, with the one that it has when that is left out
    whole = own.select(two(F.lit("left out"), "key", "known", "part").alias("group"), F.col("h").alias("other"))
    longer = members(1).select("h", F.explode(F.array_distinct(shorter)).alias("group"))
    return pairs.unionByName(longer.join(whole, "group").filter("h <> other").select("h", "other"))


def repeated(docs: DataFrame, k: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """(doc_id, no): the lines of docs (doc_id, text) that go."""
    lines = _lines(docs.select(F.col("doc_id").cast("long"), "text"), least if exact is None else min(exact, least))
    digests = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line", F.lit(2)).alias("g")]
    placed = lines.select("doc_id", "no", "line", "n", *digests, _position().cast(POSITION).alias("at"))
    many = stored(placed.groupBy("h", "g").agg(F.min("at").alias("head"), F.count("*").alias("many")).filter("many > 1").drop("many"), "heads")
    equal = placed.select("doc_id", "no", "h", "g", "at").join(few(many), ["h", "g"]).filter("at > head").select("doc_id", "no")
    if not k:
        return equal

    # candidates are pairs of 64-bit hashes, which are short rows; that two lines share one only makes more candidates
    once = placed.filter(F.col("n") >= least).join(few(many), ["h", "g"], "left").filter("head IS NULL OR at = head")
    # stored, else each use would split and hash all texts again
    single = stored(once.select("h", "at", "line", "n", (_halves(0) if k == 1 else _keys(k, range(1), False)).alias("own")), "single")
    index = F.col("own")
    probes = _halves(1) if k == 1 else _keys(k, range(k + 1), True)
    keyed = lambda keys: single.select(F.explode(keys).alias("key"), "h")
    hot = None
    if k == 1:
        hot = stored(keyed(index).groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > HOT).select("key"), "hot")
        some = few(hot)
        keyed = lambda keys: single.select(F.explode(keys).alias("key"), "h").join(some, "key", "left_anti")
    # with one edit, what a line probes for its own length are its index keys
    x, y = (keyed(F.concat(index, probes) if k == 1 else probes).alias("x"), keyed(index).alias("y"))
    pairs = x.join(y, "key").filter("x.h <> y.h").select(F.col("x.h").alias("h"), F.col("y.h").alias("other"))
    if hot is not None and hot.limit(1).count():
        pairs = pairs.unionByName(_near_in(single, hot))
    found = stored(pairs.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct(), "candidates")
    needed = stored(found.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "needed")
    texts = single.select("h", "at", "line").join(few(needed), "h")
    a, b = (texts.select(F.col("h").alias(h), F.col("at").alias(f"at_{h}"), F.col("line").alias(f"line_{h}")) for h in "ab")
    joined = found.join(a, "a").join(b, "b").filter(F.abs(F.char_length("line_a") - F.char_length("line_b")) <= k)
    near = joined.filter(within(F.col("line_a"), F.col("line_b"), k)).select(F.greatest("at_a", "at_b").alias("head")).distinct()
    # equals of a line that goes stand later than it and go already
    gone = near.select(F.expr("cast(floor(head / 4294967296BD) as bigint)").alias("doc_id"), F.expr("cast(pmod(head, 4294967296BD) as int)").alias("no"))
    return equal.unionByName(gone).distinct()


def remove_lines(docs: DataFrame, k: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """docs with the text left, and removed: the numbers of the lines that went, in order; further columns are kept, but for one of that name."""
    gone = stored(repeated(docs, k, least, exact).groupBy("doc_id").agg(F.array_sort(F.collect_set("no")).alias("removed")), "gone")
    joined = docs.drop("removed").join(few(gone, F.size("removed")), "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    # numbers that stay, by a set, and the lines by their numbers: linear in both
    left = _let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.get(lines, i)), "\n"))
    return joined.withColumn("text", F.when(F.size(removed) == 0, F.col("text")).otherwise(left)).withColumn("removed", removed)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return remove_lines(docs.withColumn("n_lines", n), exact=1).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


ORACLE = r"""
with s as materialized (select doc_id, text, string_split(text, chr(10)) as raw from documents),
l as materialized (select doc_id, no - 1 as no, trim(raw[no], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from (select doc_id, raw, unnest(range(1, len(raw) + 1)) as no from s)),
e as materialized (select doc_id, no, line, length(line) as n from l where length(line) >= 1),
u as materialized (select line, n, min(cast(doc_id as hugeint) * 4294967296 + no) as pos from e group by line, n),
h as materialized (select line, n, pos, substr(line, 1, cast(floor(n / 2) as bigint)) as f, substr(line, cast(floor(n / 2) as bigint) + 1) as g from u where n >= 25),
c as materialized (select a.line as x, b.line as y, a.pos as p, b.pos as q from h a join h b on b.n = a.n and a.line <> b.line and (b.f = a.f or b.g = a.g)
  union select a.line, b.line, a.pos, b.pos from h a join h b on b.n = a.n + 1 and (starts_with(b.line, a.f) or ends_with(b.line, a.g))),
v as materialized (select case when p < q then y else x end as line from c where levenshtein(x, y) <= 1),
g as materialized (select e.doc_id, e.no from e join u using (line) where cast(e.doc_id as hugeint) * 4294967296 + e.no > u.pos or e.line in (select line from v)),
k as (select l.doc_id, count(*) - count(r.no) as kept, cast(count(r.no) as bigint) as n_removed, string_agg(case when r.no is null then s.raw[l.no + 1] end, chr(10) order by l.no) as text
  from l join s using (doc_id) left join g r on r.doc_id = l.doc_id and r.no = l.no group by l.doc_id)
select s.doc_id, coalesce(cast(len(s.raw) as bigint), 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, case when s.text is null then null else md5(coalesce(k.text, '')) end as text_md5
from s left join k using (doc_id)
"""
