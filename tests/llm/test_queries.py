"""The registered queries: SQL where there is some, planted cases for the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from tracemill.llm import registry
from tracemill.llm.common import stored

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    c = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    order = lambda cols, data: sorted(tuple(r[cols.index(k)] for k in sorted(cols)) for r in data)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(names, c.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if int(n[2:].split("_")[0]) <= 10])
def test_one_row_per_input_row(spark, name):
    table = {"op3": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert registry.queries()[name](spark, SF).count() == want


def test_pipeline_catches_planted_cases(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    base = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    bench = spark.read.parquet(f"{SF}/../sf0.01/benchmark.parquet").orderBy("item_id").first()["text"]
    good = [r["text"] for r in base.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").filter("n_chars > 1500 AND lang = 'en'").orderBy("doc_id").limit(6).collect()]
    toxic = " ".join(["idiot moron scum pathetic worthless"] * 3)
    planted = [(9_000_000, good[0]), (9_000_001, good[1] + "\n" + bench), (9_000_002, good[2] + " write to ann.lee@mail.example.com"), (9_000_003, good[3] + " " + toxic), (9_000_004, good[4].replace(" ", "  "))]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], base.schema)
    for name, df in (("documents", base.unionByName(extra)), ("labels", labels), ("benchmark", spark.read.parquet(f"{SF}/../sf0.01/benchmark.parquet"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        if name != "tokens":
            assert docs.columns == before
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 9_000_003 not in kept["quality"] and 9_000_000 in kept["quality"]
    assert 9_000_000 not in kept["near_copies"] and 9_000_004 not in kept["near_copies"]
    left = kept["decontamination"]
    assert all(bench[:60] not in t for t in left.values())
    assert "ann.lee" not in str(kept["personal_data"].get(9_000_002, "")) and all("@mail" not in (t or "") for t in kept["personal_data"].values())
    assert docs.count() == len(kept["personal_data"])


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, mark long, spans string, keep int, key long"


def run_stages(spark, docs, sf_dir, columns=None):
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if name != "tokens" and columns:
            assert docs.columns == columns
    return docs


@pytest.mark.parametrize("schema", [DOCUMENTS, "doc_id long, text string"])
def test_stages_on_odd_tables(spark, schema):
    """Clashing columns or none but id and text; empty tables, nulls, repeated ids and rows."""
    n = len(schema.split(", "))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite another text of some length here"), (2, None), (None, "a b c d e"), (None, None), (3, ""), (4, " \n"), (5, "x" * 50_000), (6, "mail ann@example.com now " * 3)]
    rows = [(i, t, "en", "s", len(t or ""), "r", 5, "sp", 1, 9)[:n] for i, t in texts]
    df = spark.createDataFrame(rows, schema)
    assert run_stages(spark, df.limit(0), SF, df.columns).collect() == []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, df, SF), name)
        if name != "tokens":
            assert out.columns == df.columns
        if name in ("decontamination", "personal_data", "tokens"):
            assert out.count() == df.count()


def test_near_copies_keeps_different_rows_of_one_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(5, a, "x"), (5, b, "y"), (5, b, "y"), (5, b, "z"), (3, b, "w"), (7, a, "x"), (8, None, "n"), (8, "", "m"), (None, a, "q")], "doc_id long, text string, lang string")
    kept = sorted((str(r["doc_id"]), r["text"] or "", r["lang"]) for r in corpus_pipeline.near_copies(spark, df, SF).collect())
    assert kept == sorted([("5", a, "x"), ("3", b, "w"), ("8", "", "n"), ("8", "", "m"), ("None", a, "q")])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage but the classifier recomputed row by row on a small corpus with copies, passages and personal data."""
    import hashlib
    import random
    import re

    import tiktoken

    import public_tokenizers
    from tests.llm.test_operators import base_spans, brute_components, brute_hits, words_of
    from tracemill.llm import fm_index, piece_bpe

    rng = random.Random(21)
    w = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    own = lambda k: " ".join(w() for _ in range(k))
    passage = own(25)
    texts = [own(60) for _ in range(40)]
    texts += [texts[0], texts[1].upper(), texts[2] + " " + own(2), own(80) + " " + passage + " " + own(30), own(5) + " " + passage, own(40) + " mail bob.lee@example.com or 10.1.2.3 " + own(20)]
    rng.shuffle(texts)
    bench = [(1, passage), (2, own(12))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, t) for i, t in bench], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stored(stage(spark, got, str(tmp_path)), name)
    found = {r["doc_id"]: (r["n_tokens"], r["text_sha256"]) for r in got.collect()}

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=piece_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, (_, component) in enumerate(brute_components(texts)):
        if component != i:
            continue
        n, hit, _ = brute_hits([texts[i]], bench)[0]
        text = texts[i]
        if hit and hit >= 0.5 * n:
            continue
        if hit:
            at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
            p, all_words = words_of(passage), words_of(text)
            k = next(k for k in range(n) if all_words[k : k + len(p)] == p)
            text = text[: at[k][0]] + text[at[k + len(p) - 1][1] :]
        for start, _, end, kind in reversed(base_spans(text)):
            text = text[:start] + f"[{kind.upper()}]" + text[end:]
        want[i] = (len(coder.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest())
    assert found == want and len(want) == 42
    assert fm_index.WINDOW == 10
