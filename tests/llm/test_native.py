"""Quality rules, sharding and mixing: DataFrame functions against SQL and plain Python."""

import random
import zlib
from pathlib import Path

import duckdb
import pytest

from recordlens.llm import mixing, quality, sharding

FILLER = "the quick brown fox jumps over a lazy dog and then some more words follow here to make it long enough for every rule of the set"


def documents(seed=1, n=80):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lines = [" ".join(rng.choice(FILLER.split()) + rng.choice(["", ".", "!!"]) for _ in range(rng.choice([3, 12, 30]))) for _ in range(rng.choice([1, 2, 5]))]
        if d % 2:
            lines.append("All rights  reserved 20%02d." % (d % 30))
        if d % 9 == 0:
            lines += [lines[0]] * 2
        rows.append((d, "\n".join(lines), f"h{d % 3 % 2}", d))
    rows += [(900, None, "h0", 0), (901, "", None, 0), (902, " \n\t", "h1", 0), (903, "One short line.", "h0", 0), (903, "One short line.", "h0", 0), (None, FILLER, None, 0)]
    rows += [(1000 + i, "copied " * 3 + FILLER + "\n" + FILLER, "h1", 0) for i in range(20)]
    return rows


SCHEMA = "doc_id long, text string, source string, n_chars long"


def compare(df, sql, rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, source, n_chars FROM frame")
    out = con.execute(sql)
    names = [x[0] for x in out.description]
    want = sorted(([r[names.index(c)] for c in df.columns] for r in out.fetchall()), key=str)
    assert sorted((list(r) for r in df.collect()), key=str) == want


def test_quality_matches_its_sql(spark):
    rows = documents()
    df = quality.judge(spark.createDataFrame(rows, SCHEMA))
    compare(df, quality.ORACLE_SQL, rows)
    found = df.collect()
    assert any(r["n_removed_lines"] for r in found) and any(r["n_repeat_words"] for r in found)


def test_quality_counts_repeats_by_windows(spark):
    text = "a b c d e f g h x a b c d e f g h y"
    r = quality.judge(spark.createDataFrame([(1, text, "s", 0)], SCHEMA)).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (18, 16, True, False)


@pytest.mark.parametrize("longer", [0, 7])
def test_quality_spares_copies_and_removes_boilerplate(spark, longer):
    """Whether the pages of a host have one length or many makes no difference."""
    rng = random.Random(5)
    body = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    own = [(i, f"{body(40 + longer * i)}\nShared footer of the host", "h", 0) for i in range(30)]
    text = [body(20) for _ in range(8)]
    copies = [(100 + i, "\n".join(f"{x} changed{i}" if j == i % 8 else x for j, x in enumerate(text)), "h", 0) for i in range(30)]
    only = [(500 + i, "\n".join(["Shared footer of the host"] * 6), "h", 0) for i in range(2)]
    cleaned = quality.clean(spark.createDataFrame(own + copies + only, SCHEMA)).collect()
    by = {r["doc_id"]: r for r in cleaned}
    assert set(by) == {r[0] for r in own + copies}
    assert all("footer" not in by[i]["text"] and by[i]["n_chars"] == len(by[i]["text"]) for i in range(30))
    assert all(by[r[0]]["text"] == r[1] for r in copies)


def test_quality_counts_pages_of_one_length(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(60)) + "\nThe same footer", "h", 0) for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_removed_lines"] == 1 and r["kept"] for r in got)
    compare(quality.judge(spark.createDataFrame(rows, SCHEMA)), quality.ORACLE_SQL, rows)


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=8)) for _ in range(n))


@pytest.mark.parametrize("own", [15, 25, 40, 80])
def test_quality_removes_a_long_footer_of_short_pages(spark, own):
    rng = random.Random(own)
    footer = words(rng, 80)
    rows = [(i, f"{words(rng, own)}\n{footer}", "h", 0) for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_removed_lines"] == 1 for r in got)
    compare(quality.judge(spark.createDataFrame(rows, SCHEMA)), quality.ORACLE_SQL, rows)


def test_quality_rejects_pages_that_are_nearly_all_boilerplate(spark):
    rng = random.Random(8)
    shared = [words(rng, 12) for _ in range(6)]
    rows = [(i, "\n".join([words(rng, 6), *shared]), "h", 0) for i in range(100)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_removed_lines"] == 6 and not r["base_failed"] and not r["kept"] for r in got)


def near_copies(rng, first, n, lines, share=0.02):
    """Copies with random words of random lines changed."""
    out = []
    for i in range(n):
        edited = [" ".join(words(rng, 1, "klmnop") if rng.random() < share else w for w in x.split()) for x in lines]
        out.append((first + i, "\n".join(edited), "h", 0))
    return out


def test_quality_counts_a_group_of_copies_once_and_never_less(spark):
    """Sixty pages hold a line, and so do 300 near copies of one more page: the line goes from all, nothing else does."""
    rng = random.Random(9)
    line = words(rng, 9)
    pages = [(i, f"{words(rng, 40)}\n{line}", "h", 0) for i in range(60)]
    body = [words(rng, 20) for _ in range(8)]
    copies = near_copies(rng, 1000, 300, [*body, line], 0.0) + [(2000 + i, t + f"\n{line}", "h", 0) for i, t, *_ in near_copies(rng, 0, 300, body)]
    rows = pages + [(d, t, s, n) for d, (_, t, s, n) in enumerate(copies, 1000)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r["n_removed_lines"] == 1 and r["kept"] for r in got.values())
    compare(quality.judge(spark.createDataFrame(rows, SCHEMA)), quality.ORACLE_SQL, rows)


def test_quality_counts_groups_of_copies_apart(spark):
    """Near copies of twelve pages around one line are twelve documents; those of eight are not enough."""
    for pages, removed in ((12, 1), (8, 0)):
        rng = random.Random(pages)
        line, rows = words(rng, 9), []
        for p in range(pages):
            rows += [(d, t + f"\n{line}", s, n) for d, t, s, n in near_copies(rng, 100 * p, 40, [words(rng, 20) for _ in range(8)])]
        got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
        assert all(r["n_removed_lines"] == removed and r["kept"] for r in got)
    compare(quality.judge(spark.createDataFrame(rows, SCHEMA)), quality.ORACLE_SQL, rows)


def test_quality_of_a_long_text_and_clashing_names(spark):
    words = " ".join(f"wordnumber{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, words, "s", 7, "x", "y")], "doc_id long, text string, source string, n_chars int, host string, key string")
    r = quality.judge(df).first()
    assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (60_000, 0, True)
    assert tuple(quality.clean(df).first()) == (1, words, "s", 7, "x", "y")


def test_quality_of_nothing_and_of_clashing_names(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, FILLER, "h", "keep", 5)], "doc_id long, text string, source string, th string, kept int")
    assert tuple(quality.clean(df).first()) == (1, FILLER, "h", "keep", 5)


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding_matches_the_published_walk(spark):
    rows = [(i * 7919 - 500, f"text {i}", "x", 0) for i in range(300)] + [(2**63 - 1, "é", None, 0), (-(2**63), None, None, 0), (None, "n", None, 0), (7, "r", None, 0), (7, "r", None, 0)]
    df = sharding.shard(spark.createDataFrame(rows, SCHEMA))
    got = df.collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        k, data = r["doc_id"] or 0, (texts[r["doc_id"]] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (jump(k, 24), jump(k, 25)) and r["grown_shard"] in (r["shard"], 24)
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len(got) == len(rows)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sharding_matches_its_sql(spark):
    rows = documents(2, 40)
    compare(sharding.shard(spark.createDataFrame(rows, SCHEMA)), sharding.ORACLE_SQL, rows)


def test_sharding_of_long_texts_and_clashing_names(spark):
    rows = [(i, "é" * 400_000, 7, "x", -1) for i in range(3)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string, size long")).collect()
    assert {r["size"] for r in got} == {800_008} and {r["text_crc32"] for r in got} == {zlib.crc32(("é" * 400_000).encode())}
    assert {r["shard"] for r in got} == {jump(i, 24) for i in range(3)}


def labelled_documents(n=400):
    rng = random.Random(7)
    vocab = {"good": "alpha beta gamma delta".split(), "plain": "one two three four".split(), "toxic": "bad worse worst vile".split()}
    rows, labels = [], []
    for d in range(n):
        domain = rng.choices(["good", "plain", "toxic"], [6, 3, 1])[0]
        rows.append((d, " ".join(rng.choice(vocab[domain]) for _ in range(rng.randrange(5, 60)))))
        if d % 2:
            labels.append((d, domain))
    return rows, labels


def test_mixing_reaches_its_targets(spark):
    rows, labels = labelled_documents()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "alpha"), (3, rows[3][1])], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, "good"), (1, None), (2, "other")], "doc_id long, domain string")
    weights = {"good": 0.5, "plain": 0.4, "toxic": 0.1}
    got = mixing.rates(docs, known, weights).collect()
    assert len(got) == len(rows) + 4 and all(r["rate"] >= 0 for r in got)
    totals = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) for d in weights}
    for d, w in weights.items():
        assert totals[d] / sum(totals.values()) == pytest.approx(w, rel=1e-5)
    assert all(abs(sum(r[f"p_{d}"] for d in weights) - 1) < 1e-9 for r in got)
    assert all(r["tokens"] == 0 for r in got if r["doc_id"] in (5000, 5001))
    truth = dict(labels)
    held_out = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["tokens"] > 8]
    names = {rows[r["doc_id"]][1].split()[0]: r for r in held_out if r["doc_id"] < len(rows)}
    assert names["alpha"]["p_good"] > 0.9 if "alpha" in names else truth


def test_mixing_meets_a_bound_of_zero(spark):
    rows, labels = labelled_documents()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.rates(docs, known, {"good": 1.0, "plain": 0.0, "toxic": 0.0}).collect()
    assert all(r["rate"] >= 0 for r in got) and max(r["rate"] for r in got if r["p_plain"] > 0.999) < 1e-6
    mixed = mixing.mix(docs.selectExpr("doc_id", "text", "'x' as rate"), known, {"good": 0.9, "plain": 0.1, "toxic": 0.0})
    assert mixed.columns == ["doc_id", "text", "rate"] and 0 < mixed.count() <= len(rows) * 1.2


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    assert {round(r["p_a"], 6) for r in mixing.rates(docs, none, {"a": 0.5, "b": 0.5}).collect()} == {0.5}
    assert mixing.rates(docs.limit(0), none, {"a": 0.5, "b": 0.5}).count() == 0


def test_domains_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    if not Path(at).exists():
        pytest.skip("the test tables are not here")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{at}/labels.parquet"))
    model, priors = mixing.train(docs, labels.where("doc_id % 2 = 0"), list(mixing.WEIGHTS))
    held_out = labels.where("doc_id % 2 = 1")
    got = mixing.posteriors(docs.join(held_out, "doc_id", "left_semi"), model, priors).join(held_out, "doc_id").collect()
    domains = list(mixing.WEIGHTS)
    right = {d: [domains[max(range(3), key=lambda i: r["p"][i])] == d for r in got if r["domain"] == d] for d in domains}
    share = {d: sum(x) / len(x) for d, x in right.items()}
    assert share["good"] > 0.95 and share["toxic"] > 0.7 and share["plain"] > 0.4, share
