import re

import corpus_pipeline
from tests.llm.common import frame
from tests.llm.test_operators import DATA, SECRETS, brute_components

import __spark_entry__


def test_stages_have_their_effect(spark, tmp_path):
    extra = [(1000 + i, None if t is None else f"{t} the dog was in the house number {i}", lang, source) for i, t, lang, source in SECRETS if i != 9]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = frame(spark, DATA + extra).select(*columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert now.columns == columns
        now = now.cache()
        seen[name] = {r.doc_id: r for r in now.collect()}
    texts = {i: t for i, t, *_ in DATA + extra}
    letters = {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    assert set(seen["language_id"]) == letters
    exact = set(seen["exact_dedup"])
    norm = lambda i: re.sub("[\x20\x09-\x0d]", "", texts[i])
    assert {norm(i) for i in exact} == {norm(i) for i in letters} and len({norm(i) for i in exact}) == len(exact)
    _, component = brute_components(5, 80)
    near = set(seen["near_dedup"])
    groups = {}
    for i in exact:
        if i < 1000:
            groups.setdefault(component[i], set()).add(i)
    assert all(len(g & near) == 1 for g in groups.values())
    masked = seen["secret_scan"]
    assert set(masked) == near and "[SECRET]" in masked[1007].text and masked[1].text == texts[1]
    assert set(seen["best_fit_packing"]) == near
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == near


def test_rows_without_an_id_or_with_a_shared_one_keep_their_own_verdict(spark):
    long = lambda seed: " ".join(f"{seed}{k}" for k in range(60))
    rows = [
        (None, "a text without an id"), (None, "quite another one"), (None, "a text  without an id"), (None, "held by three as well"), (3, "held by three as well"),
        (5, "first text of five"), (5, "second text of five"), (4, "second text of five"), (5, "third  text of five"), (5, "third text of five"),
        (None, long("p")), (None, long("p") + " end"), (7, long("q") + " end"), (8, long("q")), (8, long("r")), (9, long("s")), (9, long("s") + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    want = [r for r in rows if r not in {(None, "a text without an id"), (None, "held by three as well"), (5, "second text of five"), (5, "third text of five")}]
    known = lambda rs: sorted((tuple(r) for r in rs), key=str)
    assert known(exact.collect()) == known(want)
    near = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, exact, "").collect()]
    assert len(near) == len(set(near)) == len(want) - 3 and set(near) <= set(want)
    assert (7, long("q") + " end") in near and (8, long("q")) not in near and (8, long("r")) in near
    assert sum((i, t[:1]) == (None, "p") for i, t in near) == 1 and sum(i == 9 for i, _ in near) == 1


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_files_of_one_name_in_two_folders_are_told_apart(spark, tmp_path):
    for lang in ("en", "de"):
        folder = tmp_path / "docs" / f"lang={lang}"
        spark.createDataFrame([(1, "a text that both hold"), (2, f"own {lang}")], "doc_id long, text string").coalesce(1).write.parquet(str(folder))
        next(folder.glob("part-*")).rename(folder / "0000.parquet")
    docs = spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text")
    assert sorted(r.text for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect()) == ["a text that both hold", "own de", "own en"]
