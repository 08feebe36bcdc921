"""Top-k search, packing, line dedup, the weak-label model and the pipeline."""

import random
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from recordlens.llm import linededup, packing, topk, weaklabels
from recordlens.llm.queries import vocabulary

DATA = Path("/root/testdata/sf0.001")


def model_topk(rows, k=5):
    sound = [(i, [float(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        scored = sorted((-int(np.dot(q, v)), j) for j, v in sound if j != i and len(v) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.3, 0.7, 1.0]) for _ in range(6)]) for i in range(160)]
    rows += [(200, [0.5] * 6), (200, [0.5] * 6), (201, None), (202, [None] * 6), (250, [float("nan")] * 6), (300, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (350, [1.0, 2.0]), (351, [3.0, -1.0])]
    rows += [(1000 + i, [0.25] * 6) for i in range(100)]
    df = spark.createDataFrame([(v, i, 1) for i, v in rows], "embedding array<float>, vec_id long, rank int").repartition(5)
    assert sorted(tuple(r) for r in topk.topk(df).collect()) == model_topk(rows)


def test_topk_of_numbers_beyond_a_long(spark):
    rows = [(0, [1e30, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0])]
    got = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id < 3")).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0), (2, 0)]


def test_topk_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(3)
    rows = [(i * 10, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    assert sorted(tuple(r) for r in topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()) == model_topk(rows)
    assert topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.topk(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(tokens, "whole"):
        tokens.whole = Tokenizer.from_file(vocabulary()["path"])
    return tokens.whole.encode(text or "", add_special_tokens=False).ids


def test_word_memory_gives_the_ids_of_the_library():
    fast, rng = packing.Tokens(**_paths(), limit=50), random.Random(4)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "don't", "Straße", "été.", "日本", "12345", "a" * 70, "<|endoftext|>", "!!", " ", " ", "\x1c", "\r\n", "I'll", "ﬁ", "👍🏽", "Ж", "x'S", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert fast.encode(text) == struct.pack(f"<{len(tokens(text))}I", *tokens(text)), repr(text)


def _paths():
    v = vocabulary()
    return {"path": v["path"], "ranks_path": v["ranks_path"]}


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 300) for _ in range(rng.choice([1, 5, 60]))}
    left = dict(counts)
    bins = packing.plan(counts, 100)
    for held, times in bins:
        assert sum(held) <= 100 and times > 0
        for x in held:
            left[x] -= times
    assert not any(left.values())
    used = sum(t for _, t in bins)
    assert used <= 1.25 * sum(a * n for a, n in counts.items()) / 100 + sum(n for a, n in counts.items() if a > 50) + 1
    assert packing.plan({}, 100) == []
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def literal_best_two_fit(lengths, capacity):
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], capacity
        while (nxt := next((x for x in left if x <= gap), None)) is not None:
            held.append(nxt)
            left.remove(nxt)
            gap -= nxt
        if gap and len(held) > 1:
            room, least = gap + held[-1], held[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= room]
            if pairs:
                _, a, b = max(pairs)
                left.append(held.pop())
                held += [a, b]
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
        bins.append(held)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_two_fit_as_it_is_written(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(rng.choice([10, 60, 150]))]
    counts = {x: lengths.count(x) for x in lengths}
    assert abs(sum(t for _, t in packing.plan(counts, 100)) - len(literal_best_two_fit(lengths, 100))) <= 1


def test_two_documents_replace_the_smallest():
    # Greedy puts 60 and 30 together with a gap of 10; 20 and 20 instead of 30 fill it.
    assert packing.plan({60: 1, 30: 1, 20: 2}, 100)[0] == ((60, 20, 20), 1)


def test_packing_is_a_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été"]) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 4000), (7, rows[7][1]), (None, "nameless")] + [(200 + i, "same") for i in range(50)]
    df = spark.createDataFrame([(t, d, 0) for d, t in rows], "text string, doc_id long, block int")
    got = packing.pack(df, **_paths(), with_ids=True).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], ids))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    texts = dict(rows)
    for d, some in pieces.items():
        times = 2 if d == 7 else 1
        want = tokens(texts[d]) + [0]
        first = sorted(some)[::times]
        assert [x for _, _, ids in first for x in ids] == want and [p for p, _, _ in first] == list(range(len(first)))
        assert all(len(ids) == 2048 for _, _, ids in first[1:]) and len(some) == times * len(first)
        assert len(first) == 1 if len(want) <= 2048 else len(first) == -(-len(want) // 2048)
    assert packing.pack(df.limit(0), **_paths()).count() == 0


def test_recurring_templates_go_from_all_but_the_first(spark):
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    near = passage.split()
    near[30] = "changed"
    rows = [(i, f"own line {chr(97 + i)} of this document stays here\nLogged in at {i}:{i} by user{i}\n{passage if i % 2 else ' '.join(near)}") for i in range(8)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, passage), (60, passage), (60, passage), (61, "unique words only")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, place string, n_chars long")
    got = {}
    for r in linededup.report(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[0][0]["text"] == rows[0][1] and got[0][0]["n_dropped"] == 0
    for i in range(1, 8):
        assert got[i][0]["text"] == rows[i][1].split("\n")[0] and got[i][0]["n_dropped"] == 2
    assert [r["kept"] for r in got[60]] == [False, False] and not got[None][0]["kept"] and got[61][0]["n_dropped"] == 0
    assert all(got[d][0]["kept"] and got[d][0]["n_dropped"] == 0 for d in (50, 51, 52))
    cleaned = linededup.clean(df)
    assert cleaned.columns == df.columns and {r["doc_id"] for r in cleaned.collect()} == {*range(8), 50, 51, 52, 61}
    assert {r["n_chars"] for r in cleaned.where("doc_id = 3").collect()} == {len(rows[3][1].split("\n")[0])}
    assert linededup.report(df.limit(0)).count() == 0


def test_leaf_parsing_generalises():
    a = [f"t{i}".encode() for i in range(10)]
    b, c = list(a), list(a)
    b[4], c[4], c[7] = b"x", b"y", b"z"
    leaf = linededup.Leaf(10, linededup.allowed_changes(10, 0.8), 3)
    assert [leaf.join(x) for x in (a, b, c, [t + b"!" for t in a])] == [0, 0, 0, 1]
    assert leaf.templates() == [b"t0 t1 t2 t3 <*> t5 t6 <*> t8 t9", b" ".join(t + b"!" for t in a)]
    assert leaf.find([b"q"] * 10) is None and leaf.size == 2
    assert linededup.allowed_changes(4, 0.8) == 0 and linededup.allowed_changes(5, 0.8) == 1


def test_lists_of_templates_change_nothing(monkeypatch):
    rng = random.Random(11)
    lines = [[b"a", b"b", b"c"] + [bytes([97 + rng.randrange(3)]) for _ in range(9)] for _ in range(600)]
    few, many = linededup.Leaf(12, 2, 3), linededup.Leaf(12, 2, 3)
    few.FEW = 10**9
    assert [few.join(x) for x in lines] == [many.join(x) for x in lines] and many.lists is not None and many.size > 50


def model_lines(rows, similarity=0.8, leading=3):
    """Each row's lines that stay, by a plain walk of the tree."""
    import re

    masked = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
    held = defaultdict(set)
    for nth, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if masked(line):
                held[masked(line)].add(nth)
    digest = lambda line: linededup._signed(linededup.xxhash.xxh64_intdigest(" ".join(line).encode(), 42))
    leaves, of = defaultdict(list), {}
    for line in sorted(held, key=lambda x: (-len(held[x]).bit_length(), digest(x))):
        heads = leaves[len(line), line[:leading]]
        like = [n for n, t in enumerate(heads) if sum(a != b for a, b in zip(t, line, strict=True)) <= int(len(line) * (1 - similarity) + 1e-9)]
        if not like:
            heads.append(line)
        of[line] = (len(line), line[:leading], like[0] if like else len(heads) - 1)
    docs = defaultdict(set)
    for line, some in held.items():
        docs[of[line]] |= {rows[n] for n in some}
    place = lambda row: (row[0] is None, row[0] or 0, digest([row[1] or ""]))
    stays = {t: min(some, key=place) for t, some in docs.items()}
    drop = lambda row, line: bool(masked(line)) and len(docs[of[masked(line)]]) > 1 and stays[of[masked(line)]] != row
    return [(d, "\n".join(x for x in (t or "").split("\n") if not drop((d, t), x))) for d, t in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "x1", "22", "omega"]
    rows = []
    for d in range(60):
        lines = [" ".join(["log", "in", rng.choice(["from", "to"])] + [rng.choice(words[: rng.choice([2, 7])]) for _ in range(rng.choice([1, 3, 7, 12]))]) for _ in range(rng.randrange(6))]
        rows.append((d, "\n".join(lines + ["", " \t "][: rng.randrange(3)])))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, "alone here"), (102, "long " * 50_000), (103, "long " * 49_999 + "tail ")]
    got = linededup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(model_lines(rows), key=key)


def test_a_leaf_in_chunks_keeps_its_templates(spark):
    rng = random.Random(3)
    rows = [(i, f"user {''.join(rng.choices('abcdefgh', k=8))} has logged in from the office again today") for i in range(400)]
    rows += [(1000 + i, f"user name has {''.join(rng.choices('abcdefgh', k=6))} {i} times over and over again") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"] for r in linededup.report(docs, leading=1).where("kept").collect()}
    assert whole == {0, 1000} == {r["doc_id"] for r in linededup.report(docs, leading=1, chunk_lines=50).where("kept").collect()}


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    n = 20000
    good = rng.random(n) < 0.8
    sees, false = np.linspace(0.4, 0.9, len(weaklabels.LABELLERS)), 0.02
    v = np.empty((n, len(weaklabels.LABELLERS)), int)
    for j, s in enumerate(sees):
        right = rng.random(n) < np.where(good, 1 - false, s)
        v[:, j] = np.where(right == good, weaklabels.GOOD, weaklabels.BAD)
        v[rng.random(n) < 0.2, j] = weaklabels.ABSTAIN
    patterns, counts = np.unique((v * 3 ** np.arange(v.shape[1])).sum(axis=1), return_counts=True)
    posterior, accuracy, prior = weaklabels.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02 and np.abs(accuracy[:, 0] - sees).max() < 0.05 and np.abs(accuracy[:, 1] - 0.98).max() < 0.02
    empty, _, _ = weaklabels.estimate(np.zeros(0, np.int64), np.zeros(0))
    assert len(empty) == 0


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_classifier_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    joined = weaklabels.score(docs).join(labels, "doc_id").collect()  # the labels are not used in training
    good, bad = [r["kept"] for r in joined if r["quality"] == 1], [r["kept"] for r in joined if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_false_alarms_are_found_out():
    rng = np.random.default_rng(2)
    n, k = 20000, len(weaklabels.LABELLERS)
    good = rng.random(n) < 0.8
    false = np.array([0.02] * (k - 1) + [0.25])
    right = rng.random((n, k)) < np.where(good[:, None], 1 - false, 0.8)
    v = np.where(right == good[:, None], weaklabels.GOOD, weaklabels.BAD)
    patterns, counts = np.unique((v * 3 ** np.arange(k)).sum(axis=1), return_counts=True)
    _, accuracy, _ = weaklabels.estimate(patterns, counts.astype(float))
    assert abs(accuracy[-1, 1] - 0.75) < 0.03 and accuracy[:-1, 1].min() > 0.95


def test_classifier_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "the words of a text. And more."), (3, "x " * 100_000)]
    got = weaklabels.score(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "3", "None"] and all(0 <= r["score"] <= 1 for r in got)
    assert weaklabels.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def model_features(text):
    words, found = text.split(), defaultdict(int)
    for before, w in zip([None, *words], words, strict=False):
        found[zlib.crc32(w.lower().encode()) % weaklabels.FEATURES] += 1
        found[zlib.crc32(b"\0" + weaklabels.shape(w).encode()) % weaklabels.FEATURES] += 1
        if w == before:
            found[weaklabels.SAME] += 1
    return found


def model_votes(text):
    import re

    words, n = text.split(), max(len(text.split()), 1)
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    rate = lambda pattern: len(re.findall(pattern, text)) / n
    stops = sum(w.lower().strip(".,;:") in weaklabels.STOP_WORDS for w in words) / n
    distinct, once = len(set(words)) / n, len(set(lines)) / max(len(lines), 1)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    figures = [(rate(r"[#*$%&|<>{}\\^~=]"), 0.15, 0.03), (rate(r"[^\W_][#*$%&|<>!?]{2,}(?!\S)|(?<!\S)[|#*]+(?!\S)"), 0.15, 0.02), (rate("[!?]{2,}"), 0.1, 0.02),
               (sum(w.isupper() and len(w) > 1 for w in words) / n, 0.3, 0.1)]
    bad = [x > high for x, high, _ in figures] + [len(words) >= 20 and stops < 0.05, len(words) >= 50 and distinct < 0.2, len(words) >= 8 and stutter > 0.2]
    good = [x < low for x, _, low in figures] + [stops > 0.12, len(words) < 50 or distinct > 0.35, stutter < 0.05]
    ends = rate(r"[.!?](?!\S)")
    bad += [len(words) >= 30 and ends < 0.02, once < 0.5]
    good += [ends > 0.04, once > 0.8]
    return [1 if b else 2 if g else 0 for b, g in zip(bad, good, strict=True)]


def test_scores_match_a_plain_model(spark):
    """Votes, features, their scores by the trained weights: a document at a time, in plain Python."""
    rng = random.Random(9)
    parts = ["the", "of", "Word", "SHOUT", "!!", "a#", "|", "x9", "stop.", "\n", "same same", "été"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 80))) for _ in range(150)] + ["again " * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = weaklabels.read(df)
    for r in rows.collect():
        at, n = np.frombuffer(r["at"], "<u2").tolist(), np.frombuffer(r["n"], "<u2").tolist()
        found = defaultdict(int)
        for a, c in zip(at, n, strict=True):
            found[a] += c
        assert found == model_features(texts[r["doc_id"]]) and r["words"] == len(texts[r["doc_id"]].split())
        assert weaklabels.digits(np.array([r["pattern"]]))[0].tolist() == model_votes(texts[r["doc_id"]])
    label, _, total = weaklabels.voted(rows)
    picked = weaklabels.sample(rows, total)
    weights, bias = weaklabels.fit([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u2") / max(r["words"], 1), label[r["pattern"]]) for r in picked])
    for r in weaklabels.score(df).collect():
        text = texts[r["doc_id"]]
        z = sum(weights[f] * c for f, c in model_features(text).items()) / max(len(text.split()), 1) + bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)


def test_the_training_sample_is_bounded(spark):
    same = spark.range(3000).selectExpr("1L as doc_id", "'the same text' as text")
    rows = weaklabels.read(same)
    assert len(weaklabels.sample(rows, 10**12, 10)) == 1
    many = weaklabels.read(spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text"))
    assert len(weaklabels.sample(many, 3000, 10)) <= 10 and len(weaklabels.sample(many, 3000, 1000)) == 1000
    assert 1 <= len(weaklabels.sample(many, 3000, 1000, train_bytes=100)) <= 20


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from recordlens.llm.common import cut

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, str(DATA)))
        assert out.columns == columns, name
        after = {r["doc_id"] for r in out.collect()}
        assert after <= before and len(after) > 0.4 * len(before)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r["doc_id"] for r in packed} == before
    assert len(corpus_pipeline.run(spark, str(DATA)).collect()) == len(packed)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_of_a_leaf_change_nothing(spark, seed):
    """Random leaves of a thousand lines, whole and in blocks, against the plain walk; nameless and repeated rows included."""
    rng = random.Random(seed)
    line = lambda: "a b c " + " ".join(rng.choice("uvwxyz" if rng.random() < 0.5 else "uv") for _ in range(rng.choice([6, 10])))
    some = [line() for _ in range(900)]
    rows = [(d if d % 9 else None, "\n".join([rng.choice(some[: rng.choice([9, 90, 900])]) for _ in range(3)])) for d in range(700)]
    rows += [(7, line()), (7, rows[7][1].split("\n")[0]), (None, "x y z only nameless rows hold this line"), (None, "x y z only nameless rows hold this line\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted(model_lines(rows), key=key)
    assert sum(text == "x y z only nameless rows hold this line" or text.startswith("x y z") for _, text in want) == 1
    for chunk_lines in (100_000, 90, 30):
        got = linededup.report(docs, chunk_lines=chunk_lines)
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == want
