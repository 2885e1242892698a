import base64
import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from quire.llm import secrets

from .fixtures import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts, poor ones, copies, a passage of the benchmark, a key; labels for most."""
    path = str(tmp_path_factory.mktemp("tables"))
    passage = "Seven wizards brew dark tea while the quick brown fox jumps over the lazy dog again."
    key = hashlib.sha1(b"k").hexdigest()
    good = {i: prose(i, 80) for i in range(120)}
    poor = {200 + i: " ".join(w.upper() + "!!" for w in prose(500 + i, 80).split()) for i in range(60)}
    special = {300: good[3], 301: good[4] + " ", 302: f"{prose(900, 40)} {passage}", 303: f'{prose(901, 60)} token = "{key}" end', 304: None, 305: ""}
    texts = {**good, **poor, **special}
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in [*good, *poor]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, key


def test_stages_in_order(spark, folder):
    path, texts, key = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
    ids = {n: set(x) for n, x in seen.items()}
    assert set(range(120)) | {300, 301, 302, 303} <= ids["quality_classifier"]
    assert not ids["quality_classifier"] & set(range(200, 260))
    assert ids["near_duplicates"] >= set(range(120)) | {302, 303} and not ids["near_duplicates"] & {300, 301}
    assert ids["near_duplicates"] - ids["decontamination"] == {302}
    assert ids["secret_scan"] == ids["decontamination"] == ids["byte_bpe"]
    changed = {i for i, r in seen["secret_scan"].items() if r.text != texts[i]}
    assert changed == {303} and seen["secret_scan"][303].text == texts[303].replace(key, secrets.MARK)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in seen["byte_bpe"].values():
        assert list(r.token_ids) == library.encode_ordinary(r.text or "") and r.round_trip


def test_run_is_the_stages(spark, folder):
    path = folder[0]
    docs = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "token_ids"} <= set(docs.columns)
    assert 110 < docs.count() < 130
