"""The word cache of packing, a Python worker's largest part: bounded, and right across its bound."""

from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers

from siltwork.llm import packing


def test_word_cache_is_bounded_and_keeps_common_words():
    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"), most=600)
    learned, learn = Counter(), cache.learn
    cache.learn = lambda words: (learned.update(words), learn(words))
    rng = np.random.default_rng(5)
    rare = ["".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(2000)]
    for at in range(0, len(rare), 50):
        texts = [" ".join(f"{w} Common other," for w in rare[at : at + 50]), ""]
        got = cache.ids([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [cache.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(cache.known) <= 600 + 54 and len(cache.at) - 1 == len(cache.known)
    assert learned[b"common"] == learned[b"other,"] == 1  # words met once went, these stayed


def test_memory_of_a_worker_is_bounded():
    assert packing._cache(None).most <= 300_000
    texts = pa.record_batch({"doc_id": pa.array(range(40)), "text": pa.array([b"word " * 10_000] * 40)})
    parts = list(packing._batches(iter([texts])))
    assert sum((ids for ids, _ in parts), []) == list(range(40)) and max(sum(map(len, t)) for _, t in parts) < 1_000_000
