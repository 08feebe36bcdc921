"""Quality rules by cross-document line frequency (operator 2), in DataFrame functions only.

Lines are normalised (white space collapsed, digits to 0, lower case) and hashed. For each host (the
``source`` of a document) the distinct documents that hold a line are counted; equal texts of a host
count once. A line in more than ``line_limit`` of them is removed, and a document that keeps too little
of its characters is rejected as depleted.

Near copies of one document share their lines without any of them being boilerplate, so they too count
once. They are told from pages around the same boilerplate by what is not shared: a line that is not frequent
is either an edited form of a frequent one (two of the three longest words of both are the same) or the text's own.
A text has content of its own if a twentieth of it are own lines, and then counts as a document. The others are copies, grouped
by the rarest frequent line they hold: a group counts one for a line, never less. Where the rarest line is edited
away, the next one leads to the group of another line that holds most of it, if that is a quarter at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import WS_CLASS, cut, let

WINDOW = 8
#: A text is a document of its own if one part in so many of its characters lies in lines of its own.
OWN = 20
#: A frequent line is at home in a group of copies that has one part in so many of its copies.
HOME = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS_CLASS}]+"), lambda w: w != "")


def normal_line(line: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(line, f"[{WS_CLASS}]+", " "), "[0-9]+", "0")
    return F.lower(F.trim(flat))


def _line_hash(line: Column) -> Column:
    return F.unhex(F.md5(normal_line(line)))


def _pairs(normal: Column) -> Column:
    """Hashes of the three pairs of a line's three longest distinct words, in order; fewer words have fewer pairs."""

    def joined(w: Column) -> Column:
        some = F.array(*(F.when(F.size(w) > j, F.xxhash64(F.get(w, i)["w"], F.get(w, j)["w"])) for i, j in ((0, 1), (0, 2), (1, 2))))
        return F.array_compact(some)

    words = F.transform(F.array_distinct(F.split(normal, " ")), lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))
    return let(F.slice(F.array_sort(words), 1, 3), joined)


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more.

    Windows are compared by a 64-bit hash of their words' hashes; they are sorted only in texts that
    have two equal ones.
    """

    def covered(windows: Column) -> Column:
        def positions(ordered: Column) -> Column:
            twin = F.filter(
                ordered,
                lambda x, j: F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(
            let(ordered, positions),
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + i + WINDOW - F.greatest(acc["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")
            ),
            lambda acc: acc["n"],
        )

    def by_hash(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW)))
        )
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, host, text hash, base columns, and its lines' hashes, pairs of words and lengths."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]"))
    split = some.select(
        "doc_id",
        "host",
        F.unhex(F.md5("text")).alias("th"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(
            words_of(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda a: F.struct(
                (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
                F.transform(a, lambda x: let(normal_line(x), lambda n: F.struct(F.unhex(F.md5(n)).alias("h"), F.char_length(x).cast("long").alias("c"), _pairs(n).alias("p")))).alias("lines"),
            ),
        ).alias("a"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return split.select("doc_id", "host", "th", "n_symbols", "w.*", "a.*").withColumn("base_failed", failed)


def _affected(marked: DataFrame, line_limit: int) -> tuple[DataFrame, DataFrame]:
    """The texts that hold a frequent line, and the frequent lines.

    (host, th, total, often: its frequent lines, rarest first, with numbers and characters, own: the other ones) and
    (host, h, n, p). Frequent is what more than ``line_limit`` different texts of a host hold.
    """
    texts = marked.groupBy("host", "th").agg(F.first("lines").alias("lines")).select("host", "th", F.inline("lines"))
    held = texts.groupBy("host", "th", "h").agg(F.count("*").alias("m"), F.sum("c").alias("c"), F.first("p").alias("p"))
    frequent = cut(held.groupBy("host", "h").agg(F.count("*").alias("n"), F.first("p").alias("p")).where(F.col("n") > line_limit))
    known = held.join(frequent.select("host", "h", "n"), ["host", "h"], "left")
    lines = known.groupBy("host", "th").agg(
        F.sum("c").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "h", "m", "c")))).alias("often"),
        F.collect_list(F.when(F.col("n").isNull(), F.struct("c", "p"))).alias("own"),
    )
    return cut(lines.where(F.size("often") > 0)), frequent


def _documents(affected: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, th, rarest, rich, often): whether an affected text has content of its own.

    A text whose edited lines were not all known is still a copy, if most that hold the same rarest line are.
    """
    pairs = cut(frequent.select("host", F.explode("p").alias("p")).distinct())
    own = affected.select("host", "th", F.posexplode("own").alias("i", "x")).select("host", "th", "i", "x.c", F.explode("x.p").alias("p"))
    edited = own.join(pairs, ["host", "p"]).select("host", "th", "i", "c").distinct().groupBy("host", "th").agg(F.sum("c").alias("edited"))
    all_own = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    told = affected.join(edited, ["host", "th"], "left").select(
        "host", "th", "often", F.get("often", 0)["h"].alias("rarest"), (OWN * (all_own - F.coalesce("edited", F.lit(0))) >= F.col("total")).alias("own_rich")
    )
    told = cut(told)
    kin = cut(told.groupBy("host", "rarest").agg((2 * F.count_if("own_rich") >= F.count("*")).alias("rich_kin")))
    return told.join(kin, ["host", "rarest"]).select("host", "th", "rarest", (F.col("own_rich") & F.col("rich_kin")).alias("rich"), "often")


def _removed(marked: DataFrame, line_limit: int) -> DataFrame:
    """(host, th, removed: set of line hashes, n_removed_lines, n_removed_chars) of texts that lose lines."""
    affected, frequent = _affected(marked, line_limit)
    docs = cut(_documents(affected, frequent))
    lines = docs.select("host", "th", "rarest", "rich", F.explode("often").alias("x")).select("host", "th", "rarest", "rich", "x.h", "x.m", "x.c")
    shares = lines.where("not rich").groupBy("host", "h", "rarest").agg(F.count("*").alias("n"))
    most = shares.groupBy("host", "h").agg(F.max(F.when(F.col("rarest") != F.col("h"), F.struct("n", "rarest"))).alias("most"), F.sum("n").alias("n"))
    home = cut(most.where(HOME * F.col("most.n") >= F.col("n")).select("host", F.col("h").alias("rarest"), F.col("most.rarest").alias("home")))
    # Two steps: a line can lead to another that has a home.
    further = home.select("host", F.col("rarest").alias("home"), F.col("home").alias("further"))
    home = home.join(further, ["host", "home"], "left").select("host", "rarest", F.coalesce("further", "home").alias("home"))
    grouped = lines.where("not rich").select("host", "h", "rarest").join(home, ["host", "rarest"], "left").select("host", "h", F.coalesce("home", "rarest").alias("group")).distinct()
    counted = lines.where("rich").select("host", "h", F.lit(None).cast("binary").alias("group")).unionByName(grouped).groupBy("host", "h").agg(F.count("*").alias("n"))
    over = cut(counted.where(F.col("n") > line_limit).select("host", "h"))
    return lines.join(over, ["host", "h"]).groupBy("host", "th").agg(
        F.collect_set("h").alias("removed"), F.sum("m").alias("n_removed_lines"), F.sum("c").alias("n_removed_chars")
    )


def _judged(marked: DataFrame, line_limit: int, least_left: float) -> DataFrame:
    all_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    joined = marked.withColumn("n_line_chars", all_chars).join(_removed(marked, line_limit), ["host", "th"], "left")
    lost = F.coalesce("n_removed_chars", F.lit(0).cast("long"))
    depleted = (F.col("n_line_chars") - lost) < least_left * F.col("n_line_chars")
    return (
        joined.withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0).cast("long")))
        .withColumn("n_removed_chars", lost)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def judge(docs: DataFrame, line_limit: int = 10, least_left: float = 0.2) -> DataFrame:
    """The rules' figures and verdict for every row of ``docs`` (doc_id, text, source; others are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_lines and n_removed_chars. A null text has no words and fails the base rules; a null
    source is the host "". Rows come back as often as they come in, null doc_ids too. No rows give no rows.
    """
    marked = cut(measured(docs))
    return _judged(marked, line_limit, least_left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_chars"
    )


def clean(docs: DataFrame, line_limit: int = 10, least_left: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that are kept, without their removed lines; n_chars, if there, follows.

    All columns of ``docs`` are returned and no others. See ``judge`` for nulls, repeats and empty tables.
    """
    marked = cut(measured(docs))
    verdict = _judged(marked, line_limit, least_left).where("kept").select(
        F.col("host").alias("__host"), F.col("th").alias("__th"), F.col("removed").alias("__removed")
    ).dropDuplicates(["__host", "__th"])
    # The row travels as one value, so that no name in it can clash with those used here.
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__host"),
        F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__th"),
        F.struct(*docs.columns).alias("row"),
    )
    joined = rows.join(verdict, ["__host", "__th"])
    left = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains(F.col("__removed"), _line_hash(x)))
    text = F.when(F.col("__removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return rewritten(joined, docs.columns, text, F.col("__removed").isNotNull())


def rewritten(rows: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of ``row`` with another text; n_chars, if there, follows where the text has changed."""
    out = rows.withColumn("__text", text).withColumn("__changed", changed)
    n_chars = F.when(F.col("__changed"), F.char_length("__text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None
    given = {"text": F.col("__text"), "n_chars": n_chars}
    return out.select(*(given[c].alias(c) if given.get(c) is not None else F.col("row").getField(c).alias(c) for c in columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS s FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8
), h AS (
  SELECT r, i, array_to_string(words[i : i + 7], ' ') AS win FROM g
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM h) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY r
), b AS (
  SELECT w.r, doc_id, host, s, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, ls
  FROM w LEFT JOIN rep ON w.r = rep.r
), n AS (
  SELECT r, host, s, length(line) AS c, lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS norm
  FROM (SELECT r, host, s, unnest(ls) AS line FROM b)
), held AS (
  SELECT host, s, norm, sum(c) / count(DISTINCT r) AS c FROM n GROUP BY ALL
), frequent AS (
  SELECT host, norm, count(*) AS n FROM held GROUP BY ALL HAVING count(*) > 10
), longest AS (
  SELECT norm, list_transform(list_sort(list_transform(list_distinct(string_split(norm, ' ')), lambda w: {'n': -length(w), 'w': w}))[1:3], lambda x: x.w) AS w
  FROM (SELECT DISTINCT norm FROM held)
), pair AS (
  SELECT norm, unnest(list_filter([[w[1], w[2]], [w[1], w[3]], [w[2], w[3]]], lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL)) AS p FROM longest
), touched AS (
  SELECT host, s, sum(c) AS total FROM held GROUP BY ALL HAVING count(*) FILTER ((host, norm) IN (SELECT (host, norm) FROM frequent)) > 0
), edited AS (
  SELECT DISTINCT host, norm FROM held JOIN pair USING (norm) WHERE (host, p) IN (SELECT (host, p) FROM frequent JOIN pair USING (norm))
), own AS (
  SELECT host, s, sum(c) AS c FROM held JOIN touched USING (host, s)
  WHERE (host, norm) NOT IN (SELECT (host, norm) FROM frequent) AND (host, norm) NOT IN (SELECT (host, norm) FROM edited) GROUP BY ALL
), often AS (
  SELECT host, s, norm, first(md5(norm)) OVER (PARTITION BY host, s ORDER BY n, md5(norm)) AS rarest FROM held JOIN frequent USING (host, norm)
), told AS (
  SELECT t.host, t.s, o.rarest, 20 * coalesce(own.c, 0) >= total AS own_rich FROM touched t
  JOIN (SELECT DISTINCT host, s, rarest FROM often) o ON o.host = t.host AND o.s = t.s LEFT JOIN own ON own.host = t.host AND own.s = t.s
), rich AS (
  SELECT host, s, own_rich AND 2 * count(*) FILTER (own_rich) OVER w >= count(*) OVER w AS rich FROM told WINDOW w AS (PARTITION BY host, rarest)
), shares AS (
  SELECT host, norm, rarest, count(*) AS n FROM often JOIN rich USING (host, s) WHERE NOT rich GROUP BY ALL
), home AS (
  SELECT host, md5(norm) AS rarest, arg_max(rarest, (n, rarest)) FILTER (rarest <> md5(norm)) AS home
  FROM shares GROUP BY host, norm HAVING 4 * max(n) FILTER (rarest <> md5(norm)) >= sum(n)
), homes AS (
  SELECT a.host, a.rarest, coalesce(b.home, a.home) AS home FROM home a LEFT JOIN home b ON a.host = b.host AND a.home = b.rarest
), over_ AS (
  SELECT host, norm FROM (
    SELECT o.host, o.norm, NULL AS g FROM often o JOIN rich USING (host, s) WHERE rich
    UNION ALL SELECT DISTINCT o.host, o.norm, coalesce(home, o.rarest) FROM often o JOIN rich USING (host, s) LEFT JOIN homes ON homes.host = o.host AND homes.rarest = o.rarest WHERE NOT rich)
  GROUP BY ALL HAVING count(*) > 10
), lost AS (
  SELECT r, count(*) AS n_lines, sum(c) AS n_chars FROM n JOIN over_ USING (host, norm) GROUP BY r
), total AS (
  SELECT r, sum(c) AS n FROM n GROUP BY r
), j AS (
  SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(n_lines, 0)::BIGINT AS n_removed_lines, coalesce(lost.n_chars, 0)::BIGINT AS n_removed_chars, coalesce(total.n, 0) AS n_line_chars
  FROM b LEFT JOIN lost ON b.r = lost.r LEFT JOIN total ON b.r = total.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_line_chars - n_removed_chars < 0.2 * n_line_chars) AS kept, n_removed_lines, n_removed_chars
FROM j
"""
