"""The pipeline's stages on odd rows, and all of it against plain Python on a small table."""

import warnings
from collections import defaultdict

import pytest

import corpus_pipeline
from recordlens.llm import linededup, mixing, packing, quality
from recordlens.llm.common import cut, drop_cuts, made_so_far
from recordlens.llm.queries import vocabulary
from test_learned_and_packed import model_lines, tokens
from test_neardup import model_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon omega".split()


def text(i, n=60):
    return " ".join(f"{WORDS[(i * 7 + j * j) % 15]}{chr(97 + (i * 3 + j) % 26)}{chr(97 + (i + j * 5) % 26)}" for j in range(n))


def documents():
    rows = [(i, text(i) + "\n" + text(i + 500, 30)) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(200 + i, rows[i][1].replace(" ", " changed ", 1)) for i in range(4, 8)]  # near copies
    rows += [(300 + i, text(i + 900) + "\nA footer that all pages of the host have") for i in range(20)]
    rows += [(400, "too short"), (401, None), (402, ""), (7, text(777)), (7, text(777)), (None, text(778)), (403, " \n\t")]
    return [(d, t, "en", "host" if d and 300 <= d < 320 else "other", len(t or "")) for d, t in rows]


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 3 and 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def model_quality(rows):
    """The rows that stay, without the footer, which is the one line of a host in more than ten documents."""
    out = []
    for d, t in rows:
        if len((t or "").split()) < 20:
            continue
        out.append((d, "\n".join(x for x in t.split("\n") if not x.startswith("A footer"))))
    return out


def model_line_dedup(rows):
    return [(d, left) for (d, t), (_, left) in zip(rows, model_lines(rows), strict=True) if left == t or left.split()]


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r[0], r[1]) for r in documents()]
    docs, rows = cut(corpus_pipeline.quality_rules(spark, docs, sf_dir)), model_quality(rows)
    assert kept(docs) == sorted(rows, key=str)
    docs, rows = cut(corpus_pipeline.line_dedup(spark, docs, sf_dir)), model_line_dedup(rows)
    assert kept(docs) == sorted(rows, key=str)
    docs = cut(corpus_pipeline.near_dedup(spark, docs, sf_dir))
    named = [r for r in rows if r[0] is not None]
    assert sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None) == model_dedup(sorted(set(named)))
    before = docs.collect()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        some = mixing.rates(docs, mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), mixing.WEIGHTS, stay=mixing.STAY).collect()
        docs = cut(corpus_pipeline.target_mix(spark, docs, sf_dir))
    times = defaultdict(int)
    for r in docs.collect():
        times[r["doc_id"], r["text"]] += 1
    copies = defaultdict(int)
    for r in some:
        copies[r["doc_id"]] += r["copies"]
    assert {k[0]: n for k, n in times.items()} == {d: n for d, n in copies.items() if n} and {k for k in times} <= {(r["doc_id"], r["text"]) for r in before}
    packed = corpus_pipeline.best_two_fit(spark, docs, sf_dir).collect()
    lengths = defaultdict(int)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert dict(lengths) == {d: sum(n * (len(tokens(t)) + 1) for (e, t), n in times.items() if e == d) for d, _ in times}


def test_run_gives_what_its_stages_do_and_cleans_up(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
        want = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        since = made_so_far()
        got = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert made_so_far() - since <= 3  # the last stage's documents and what it still reads


ODD = [
    [],
    [(1, None, None, None, None), (None, None, None, None, None)],
    [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, " \n ", None, None, 3)],
    [(1, text(1), "en", "s", 1)] * 3 + [(1, text(2), "en", "s", 1), (None, text(1), "en", None, 1)],
    [(1, "w " * 200_000, "en", "s", 1), (2, text(3) + "\n" + "x" * 300_000, "en", "s", 1)],
]


@pytest.mark.parametrize("rows", ODD, ids=["none", "nulls", "empty", "repeats", "long"])
def test_stages_of_odd_rows(spark, sf_dir, rows):
    """No stage fails; each keeps the columns, extra ones too, and invents no row."""
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, row int")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns, name
            held = out.collect()
            assert {r["doc_id"] for r in held} <= {r[0] for r in rows} and all(r["key"] == "x" and r["row"] == 1 for r in held)
        assert len(packing.pack(df, **vocabulary()).collect()) >= len(rows)


def test_dropping_cuts_keeps_the_last(spark):
    since = made_so_far()
    a, b = cut(spark.range(3)), cut(spark.range(4))
    drop_cuts(spark, since)
    assert b.count() == 4 and made_so_far() == since + 1
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark says of files that are gone
        a.count()


def test_quality_and_lines_of_the_whole_table_agree_with_their_reports(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert quality.clean(docs).count() == quality.judge(docs).where("kept").count()
    assert linededup.clean(docs).count() == linededup.report(docs).where("kept").count()
