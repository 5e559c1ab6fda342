"""Each stage of the pipeline against a plain version, with null and repeated ids and texts."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from siltwork.llm import decontaminate, language, minhash, pii

from .test_operators import ORDER, brute_hits, brute_near, brute_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the cat and dog are here with some more of that what it was", "de": "der hund und die katze sind hier mit etwas mehr von dem was", "fr": "le chat et chien sont ici avec un peu plus de ce que", "es": "el gato y perro están aquí con algo más de eso que"}
PASSAGE = " ".join(f"passage{i}" for i in range(40))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        lang = list(WORDS)[i % 4]
        text = " ".join(f"{w}{rng.integers(0, 60)} {w}" for w in rng.choice(WORDS[lang].split(), int(rng.integers(3, 60))))
        rows.append((i, text, lang if i % 3 else None))
    rows += [(90, None, "en"), (91, "", "en"), (92, " 12 % ", "de"), (None, rows[5][1], "de"), (None, rows[6][1] + " x1", None), (None, "nur ein hund und eine katze", None)]
    rows += [(7, rows[7][1], "es"), (7, rows[7][1], "es"), (7, rows[9][1], None), (95, f"{PASSAGE} and the cat", None), (95, "the dog and the cat are here", "en"), (None, PASSAGE.upper(), "fr")]
    rows += [(97, "Frau Anna Berg and bob@example.com at 10.1.2.3", "en"), (98, "write to bob@example.com or Frau Berg", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    data = [(d, t, x, "s", None if t is None else len(t)) for d, t, x in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "not there at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language_stage(spark, docs, sf):
    out = pipeline.language_id(spark, docs, sf)
    assert out.columns == docs.columns
    assert rows(out) == Counter({k: n for k, n in rows(docs).items() if k[1] and re.search(r"[^\W\d_]", k[1])})
    model = language.train(docs.where(~language.held_out()))
    want = Counter((r.text, r.lang_pred) for r in language.identify(docs, model).collect() if r.lang_pred != "und")
    assert Counter((r.text, r.lang) for r in out.collect()) == want
    known = {r.text: r.lang for r in docs.collect() if r.lang}
    assert np.mean([known[r.text] == r.lang for r in out.collect() if r.text in known]) > 0.95


def test_near_duplicates_stage(spark, docs, sf):
    out = pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    data = [(r.doc_id, r.text) for r in docs.collect()]
    # one of each component, with its smallest id; texts without words stay
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert rows(out) - rows(docs) == Counter()
    groups = components(data)
    kept = Counter(groups[x] for x in left if groups[x] is not None)
    assert set(kept.values()) == {1} and len(kept) == len({g for g in groups.values() if g is not None})
    smallest = {}
    for (d, t), g in groups.items():
        if g is not None:
            smallest[g] = min(smallest.get(g, ORDER(None)), ORDER(d))
    assert all(ORDER(d) == smallest[groups[(d, t)]] for d, t in left if groups[(d, t)] is not None)
    assert sum(1 for x in left if groups[x] is None) == sum(1 for x in data if groups[x] is None)


def brute_order(data):
    """brute_near without sorting: by row."""
    numbered = [(i, t) for i, (_, t) in enumerate(data)]
    return sorted(brute_near(numbered, 80))


def components(data):
    """The component of each pair of id and text; None without words."""
    return {x: (c if n else None) for x, (_, n, c, _) in zip(data, brute_order(data), strict=True)}


def test_decontamination_stage(spark, docs, sf):
    out = pipeline.decontamination(spark, docs, sf)
    assert out.columns == docs.columns
    bad = {t for d, t in rows(docs) if brute_hits([(d, t)], [(1, PASSAGE), (2, None), (3, "not there at all")])[0][4]}
    assert len(bad) == 2 and rows(out) == Counter({k: n for k, n in rows(docs).items() if k[1] not in bad})


def test_pii_stage(spark, docs, sf):
    out = pipeline.personal_data(spark, docs, sf)
    assert out.columns == docs.columns and out.schema == docs.schema
    want = Counter((r.doc_id, r.text) for r in pii.replace_pii(docs.select("doc_id", "text"), pipeline.PII_KEY).collect())
    assert rows(out) == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    text = {r.doc_id: r.text for r in out.collect()}
    mail = re.search(r"\S+@\S+", text[97])[0]
    assert mail in text[98] and "bob" not in mail and text[97].split()[2] == text[98].split()[-1] != "Berg"


def test_packing_stage(spark, docs, sf):
    got = sorted((ORDER(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pipeline.packed(spark, docs, sf).collect())
    assert got == brute_pieces([(r.doc_id, r.text) for r in docs.collect()])


def test_run_is_its_stages(spark, sf, docs):
    out = pipeline.run(spark, sf)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    step = docs
    for name, stage in pipeline.STAGES:
        step = stage(spark, step, sf)
        if name != "packing":
            step = spark.createDataFrame(step.collect(), docs.schema)
    key = lambda df: sorted((ORDER(r.doc_id), r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(out) == key(step) and len({(r.sequence_id, r.offset) for r in out.collect()}) == out.count()


def test_stages_of_an_empty_table(spark, docs, sf):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert minhash.near_duplicates(docs.limit(0)).count() == decontaminate.decontaminate(docs.limit(0), docs.limit(0).withColumnRenamed("doc_id", "item_id")).count() == 0
