import hashlib
import json
import math
import re
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.functions import hashing, text

SAMPLES = ["ﬁligree ２０２６ ｆｕｌｌ e\u0301t\u00e9 ﬀ.ﬃ ½", "The cat-sat on a/b:c.d!", "Straße und ÄÖÜ", "", "a\u2028b  c", "x_1 y.z 9,5 €", "one"]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_tokenisers_agree_with_unicode_regular_expressions(spark):
    assert column(spark, SAMPLES, text.joined_words) == [re.findall(r"[\w]+(?:[-.:/][\w]+)*|[^\w\s]", s) for s in SAMPLES]
    assert column(spark, SAMPLES, text.plain_words) == [re.findall(r"\w+|[^\w\s]", s) for s in SAMPLES]
    assert column(spark, SAMPLES, lambda c: F.array_sort(text.lookup_tokens(c, 2))) == [
        sorted({t for t in re.findall(r"[A-Za-z0-9_.:/=-]+", s.lower()) if len(t) > 2}) for s in SAMPLES
    ]


def test_token_cost_counts_quarters_of_bytes(spark):
    cost = lambda s: sum(max(1, math.ceil(len(t.encode()) / 4)) if re.match(r"\w", t) else 1 for t in re.findall(r"\w+|[^\w\s]", unicodedata.normalize("NFKC", s)))
    assert column(spark, SAMPLES, text.token_cost) == [cost(s) for s in SAMPLES]


def test_normalisers(spark):
    assert column(spark, ["  A  b\tC ", None], text.collapse) == ["a b c", None]
    assert column(spark, ["ﬁne ß", "İ"], text.nfkc_casefold) == [unicodedata.normalize("NFKC", s).casefold() for s in ("ﬁne ß", "İ")]
    assert column(spark, ["https://doi.org/10.1234/AbC", "doi:10.1/x", "10.12345/y z"], text.normal_doi) == ["10.1234/abc", "10.1/x", "10.12345/y z"]
    assert column(spark, ["https://doi.org/10.1234/AbC", "doi:10.1/x", "10.12345/y z"], text.is_doi) == [True, False, False]
    assert column(spark, ["1.0", "v1.0"], text.expected_tag) == ["v1.0", "v1.0"]


def test_timestamps_need_a_zone(spark):
    got = column(spark, ["2026-08-13T03:55:06Z", "2026-08-13T03:55:06+02:00", "2026-08-13T03:55:06", "junk", None], text.zoned_timestamp)
    assert [g is not None for g in got] == [True, True, False, False, False]
    assert (got[0] - got[1]).total_seconds() == 7200


def test_paths_globs_and_versions(spark):
    assert column(spark, ["a/b", "/a", "a/../b", "", ".", "a\\b", "C:/x", "a..b"], text.safe_path) == [True, False, False, False, False, False, False, True]
    assert column(spark, ["x/.env", ".git/config", "a/secrets/b/c", "ok.txt"], lambda c: text.matches_any_glob(c, ["*/.env", ".git/*", "*/secrets/*"])) == [True, True, True, False]
    got = column(spark, ["1.2.3", "1.2.3-rc.1+b", "01.2.3", "1.2.3-01", "1.2"], text.semver)
    assert [g and (g["major"], g["pre"], g["build"]) for g in got] == [(1, "", ""), (1, "rc.1", "b"), None, None, None]
    stable = column(spark, ["1.2.3", "1.2.3-rc.1"], lambda c: text.channel_matches(c, F.lit("stable")))
    assert stable == [True, False]


def test_release_identity_names_what_is_amiss(spark):
    sha = "a" * 40
    rows = [
        ("https://github.com/o/r/releases/tag/v1%2E0", f"https://github.com/o/r/tree/{sha}", "v1.0", sha),
        ("https://example.com/o/r/releases/tag/v1.0", f"https://github.com/o/r/tree/{sha}", "v1.0", sha),
        ("https://github.com/o/r/releases/tag/v2", f"https://github.com/o/r/tree/{sha}", "v1.0", sha),
        ("https://github.com/o/r/releases/tag/v1.0", f"https://github.com/o/x/tree/{sha}", "v1.0", sha),
        ("https://github.com/o/r/releases", f"https://github.com/o/r/tree/{sha}", "v1.0", sha),
        ("https://github.com/o/r/releases/tag/v1.0", f"https://github.com/o/r/tree/{sha}", None, sha),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r[0] for r in df.select(text.release_identity(*(F.col(c) for c in "abcd"))).collect()]
    assert got[0]["repository"] == "o/r" and got[0]["reason"] is None
    assert [g["repository"] for g in got[1:]] == [None] * 5
    assert [g["reason"] for g in got[1:]] == ["not from the release host", "the page is another tag's", "the snapshot pins something else", "not the page of a release", "no tag"]


def test_texts_between_markers_and_lines(spark):
    assert column(spark, ["a<x>b</x>c", "none", "<x>open"], lambda c: text.between_markers(c, "<x>", "</x>")) == ["b", None, None]
    assert column(spark, ["BOUNDARY\tx\nkeep\ndrop\n"], lambda c: text.drop_lines(c, ["BOUNDARY\t"], ["drop"])) == ["keep\n"]


def test_payload_walks(spark):
    payload = json.dumps({"b": ["x", {"a": "y"}], "a": 1, "c": " "})
    assert column(spark, [payload], text.payload_text) == ["a\n1\nb\nx\na\ny\nc"]
    assert column(spark, [payload], text.payload_strings) == [["x", "y"]]


def test_canonical_json(spark):
    assert column(spark, ['{"b": 1.0, "a": "é"}', None], hashing.canonical_json) == ['{"a":"é","b":1.0}', None]
    with pytest.raises(ValueError):
        hashing.canonical(float("nan"))


def test_ratio_is_null_without_a_whole(spark):
    df = spark.createDataFrame([(1, 128), (1, 0), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(hashing.ratio(F.col("a"), F.col("b"))).collect()] == [0.007812, None, 0.666667]


def model_embedding(s):
    tokens = re.findall(r"[\w]+(?:[-.:/][\w]+)*|[^\w\s]", unicodedata.normalize("NFKC", s).casefold())
    v = np.zeros(256)
    for f, w in [*((f"u\0{t}", 1.0) for t in tokens), *((f"b\0{a}\0{b}", 0.5) for a, b in zip(tokens, tokens[1:], strict=False))]:
        d = hashlib.sha256(f.encode()).digest()
        v[struct.unpack("<I", d[:4])[0] % 256] += w * (1 if d[4] & 1 else -1)
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v


def test_embedding_matches_a_model(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    got = {r[0]: np.array(r[1]) for r in hashing.dense(hashing.embed(rows, "i", "t"), "i").collect()}
    for i, s in enumerate(SAMPLES):
        if s:
            assert np.allclose(got[i], model_embedding(s), atol=1e-12)
        else:
            assert i not in got


def test_half_precision_round_trip(spark):
    v = [0.1, -2.5, 1e-8]
    assert column(spark, [v], hashing.half_precision, "array<double>") == [np.array(v, np.float16).astype(float).tolist()]
    packed = column(spark, [v], hashing.pack_f16, "array<double>")[0]
    assert hashing.unpack_f16(bytes(packed), 3).tolist() == [np.array(v, np.float16).astype(float).tolist()]
    with pytest.raises(ValueError):
        hashing.unpack_f16(b"123", 3)


def test_ordered_hash_ignores_the_order_of_rows(spark):
    rows = [("b", "2"), ("a", "1")]
    want = hashlib.sha256(b"a=1;b=2;").hexdigest()
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "k string, v string")
        assert hashing.ordered_hash(df, ["k"], F.concat("k", F.lit("="), "v", F.lit(";"))).first()[0] == want


def test_features_of_many_texts_are_not_remembered():
    """What a worker holds does not grow with the texts it has seen."""
    import tracemalloc

    from recordlens.functions.hashing import feature_counts

    tracemalloc.start()
    for i in range(200):
        feature_counts(" ".join(f"w{i}x{j}" for j in range(300)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2 << 20


def test_leaves_come_in_bounded_batches(monkeypatch):
    """One batch of Spark with many texts is many small ones: the leaves are all there and in order."""
    import json

    import pyarrow as pa

    from recordlens.functions import pointers

    monkeypatch.setattr(pointers, "LEAVES", 100)
    payloads = [json.dumps({"a": "x" * 20, "b": [i, "y", {"c": "z"}]}) for i in range(300)] + [None, '"t"']
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array(payloads)], ["key", "payload"])
    out = list(pointers._leaves([batch]))
    assert max(b.num_rows for b in out) < 30
    one = [("/@0", "a", True), ("/@0", "x" * 20, False), ("/@1", "b", True), ("/@1/1", "y", False), ("/@1/2/@0", "c", True), ("/@1/2/@0", "z", False)]
    got = [(r["key"], r["path"], r["text"], r["is_key"]) for b in out for r in b.to_pylist()]
    assert got == [(i, *leaf) for i in range(300) for leaf in one] + [(301, "", "t", False)]
