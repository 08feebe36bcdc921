from recordlens.llm import linededup


def test_a_line_in_two_documents_stays_in_the_first_only(spark):
    line = " ".join(f"{c}word" for c in "abcdefghijklmnopqrstuvwxyz" * 2)
    rows = [(1, f"one of its own\n{line}"), (2, f"{line}\nsomething else entirely here"), (3, "no part in any of this at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: "something else entirely here", 3: rows[2][1]}
    assert {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.report(docs).collect()} == {d: (int(d == 2), t) for d, t in want.items()}
    assert {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()} == want
