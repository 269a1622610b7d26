"""Inputs that once ended or stalled the text operators, and operators run where the package is not installed."""

import os
import random
import subprocess
import sys
import textwrap
import time
from collections import Counter

import pytest

from logloom.llm import backoff, common, decontaminate, jaccard, pieces, secrets, tokencount, toxicity

P = pytest.importorskip("public_tokenizers")
BPE, SPM = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_literals_that_are_added_to_themselves():
    start = time.perf_counter()
    text = 'secret_key = "Zx81hhq0PPwm2"\n' + "secret_key = secret_key + secret_key\n" * 2000
    assert [s[:2] for s in secrets.scan(text) if s[2] == "pair"] == [(14, 27)]
    grown = 'api_secret = "Zx81hhq0"\n' + "".join(f'api_secret = api_secret + "part{i}"\n' for i in range(5000))
    assert sum(s[2] == "pair" for s in secrets.scan(grown)) == 5001
    assert time.perf_counter() - start < 20
    assert "Zx81" not in secrets.masked(text)


def test_joined_literals_score_as_their_text():
    rng = random.Random(3)
    for _ in range(50):
        texts = ["".join(rng.choices("abcXYZ019 .", k=rng.randint(1, 3000))) for _ in range(3)]
        literal = secrets.Literal.joined([secrets.Literal(t, []) for t in texts])
        if sum(map(len, texts)) > secrets.JOINED_LENGTH:
            assert literal.text is None and literal.score() == secrets.points_of(Counter("".join(texts)))
        else:
            assert literal.score() == secrets.literal_score("".join(texts))


def test_long_pre_tokens_merge_as_short_ones(monkeypatch):
    vocabulary = tokencount.load_vocabulary(BPE)
    rng = random.Random(1)
    words = ["".join(rng.choices(letters, k=rng.randint(2, 150))).encode() for letters in ("ab", "the ing", "漢字かな", "0123456789abcdef") for _ in range(60)]
    plain = [vocabulary.merges.pieces(w) for w in words]
    monkeypatch.setattr(tokencount, "LONG_WORD", 1)
    assert [vocabulary.merges.pieces(w) for w in words] == plain
    monkeypatch.undo()
    start = time.perf_counter()
    assert tokencount.text_counter(vocabulary)("a" * 200_000) > 0
    assert time.perf_counter() - start < 20


def test_long_runs_of_spaces(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SPM)
    table = pieces.load_pieces(SPM)
    encoder = pieces.Encoder(table)
    rng = random.Random(2)
    texts = [" " * n for n in (1, 2, 47, 49, 1000, 5000)] + ["a" + " " * 301 + "b"] + ["".join(rng.choices("ab ▁漢é\n", k=400)) for _ in range(30)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode(text)
    short = pieces.Encoder(table)
    monkeypatch.setattr(pieces, "LONG_UNIT", 1)
    for text in texts[:2] + texts[6:]:
        assert pieces.Encoder(table).merge_long(text[:60].replace(" ", "▁")) == short.merge(text[:60].replace(" ", "▁"))
    start = time.perf_counter()
    encoder.encode("x" + " " * 100_000)
    assert time.perf_counter() - start < 20


def test_ids_of_any_kind_are_scored(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("al be ca do en fi".split(), k=rng.randint(0, 40))) for _ in range(80)]
    sparse = [rng.getrandbits(60) for _ in texts]
    by_kind = []
    for ids, kind in ((list(range(80)), "long"), (sparse, "long"), ([f"doc-{i}" for i in range(80)], "string"), ([None] * 80, "long")):
        frame = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        scored = backoff.score_documents(frame, 2, leave_one_out=True).collect()
        by_kind.append(sorted((r["n_words"], r["n_backoff"], round(r["log_score"], 6)) for r in scored))
    assert by_kind[0] == by_kind[1] == by_kind[2] == by_kind[3]
    frame = spark.createDataFrame(list(zip(sparse, texts)), "doc_id long, text string")
    # Blocks are made by text, not by how far apart the ids are.
    assert backoff.blocks_of(frame, "doc_id", "text").select("block").distinct().count() < 30


def test_repeated_ids_stay_within_the_sample(spark):
    rows = [(1, f"bad thing {i}") for i in range(300)] + [(i, "a good text") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1 or i % 2)) for i in range(1, 40)], "doc_id long, toxic int")
    settings = toxicity.Settings(max_rows=20)
    assert toxicity.labelled_sample(docs, labels, settings).count() <= 20
    assert toxicity.score_texts(docs, toxicity.fit(docs, labels, settings)).count() == len(rows)


NAMES = ["_gone", "_root", "_node", "_spans", "_id", "_n", "_again", "_row", "spans", "node", "root", "word"]


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES) + ", `a.b` int"
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i < 5 else f"own text {i} " * 8, *NAMES, i) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(docs).count() == 8
    twice = docs.union(docs)
    assert jaccard.keep_one(twice).columns == docs.columns and jaccard.keep_one(twice).count() == 8
    items = spark.createDataFrame([(i, f"own text {i} " * 8) for i in range(6, 9)], "item_id long, text string")
    for words in (10, 100_000):
        kept = decontaminate.drop_contaminated(docs, items, block_words=words)
        assert kept.columns == docs.columns and kept.count() == 9


def test_fresh_names():
    assert common.fresh(["a", "_N", "_n_"], "_n") == "_n__"


def test_workers_without_the_package(tmp_path):
    """Started elsewhere, with the package on the driver's path alone."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import functions as F
        from logloom.session import builder, prepare
        from logloom.llm import decontaminate, extraction, merkle, negatives, pieces, secrets, tokencount
        spark = prepare(builder().master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
        text = " ".join(f"w{{i}}" for i in range(30))
        docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert decontaminate.judge(decontaminate.find_overlaps(docs, items)).filter("contaminated").count() == 1
        assert decontaminate.drop_contaminated(docs, items).count() == 1
        assert tokencount.count_tokens(docs, {BPE!r}).count() == 2
        assert pieces.decode_ids(pieces.encode_texts(docs, {SPM!r}), {SPM!r}).filter("text = 'other words'").count() == 1
        assert secrets.find_secrets(docs).count() == 2
        pages = spark.createDataFrame([(1, "<article><p>" + text + ".</p></article>")], "page_id long, html string")
        assert extraction.extract(pages).count() == 1
        assert merkle.manifest(docs, ("doc_id", "text"), "text").filter("verified").count() == 2
        vectors = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int")
        assert negatives.mine(vectors, F.col("vec_id") == 0).count() >= 0
        print("all there")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all there" in done.stdout, done.stderr[-3000:]


def test_similarity_lets_go_between_its_steps(spark, monkeypatch):
    """What a step leaves on the driver goes before the next one: after the index, the candidates, the texts and the links."""
    from logloom.llm import jaccard

    calls = []
    monkeypatch.setattr(jaccard, "release", lambda s: calls.append(s))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "x y z w v")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3} and len(calls) >= 4
