import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.util import documents, save
from vellum.llm.queries import op2
from vellum.llm.tokens import compose, count_column, transducer, with_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    assert count_column(pa.array(texts, pa.string()), PATH).tolist() == brute(texts)


def test_hard_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcest'rlmvd  \n\t.!0123éß€ 漢🙂　xTHEე0") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>", "a  <|endoftext|>  b", "a" * 5000, " " * 3000 + "x", "ab" * 4000, "\n" * 1000, "don't we'll 've''s 's !'s \n'll", "ꟋᲉ\U000116d0"]
    assert count_column(pa.array(texts, pa.string()), PATH).tolist() == brute(texts)


def test_query(spark, tmp_path):
    texts = [None, "", "hello world", "wörter " * 300, "x" * 2000, "a", "a"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op2.query(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, brute(texts)))}


def test_names_and_empty(spark):
    docs = documents(spark, ["a b", "a b", None]).withColumnsRenamed({"lang": "N_tokens", "source": "text_"})
    counted, name = with_token_counts(docs, PATH)
    assert name == "_n_tokens" and counted.columns == [*docs.columns, name] and sorted(r[name] for r in counted.collect()) == [0, 2, 2]
    assert with_token_counts(docs.where("false"), PATH)[0].count() == 0


def test_state_maps():
    """Maps are closed under each other, and composing them from any entry is running on from it."""
    rng = random.Random(12)
    machine = transducer(PATH)
    body = np.frombuffer("".join(rng.choice("abcdetionsr") for _ in range(4000)).encode(), np.uint8)
    at = np.arange(0, 4000, 40)
    size, last = np.full(100, 40), np.zeros(100, bool)
    last[[59, 99]] = True
    chunk, entry, leave, total = machine.state_maps(body, at, size, last)
    assert chunk[:100].tolist() == list(range(100)) and not entry[:100].any() and len(chunk) > 100
    have = set(zip(chunk.tolist(), entry.tolist()))
    assert len(have) == len(chunk) and all(last[c] or (c + 1, s) in have for c, s in zip(chunk.tolist(), leave.tolist()))
    whole = compose(chunk, entry, leave, total, last)
    ends = np.where(chunk < 60, 2400, 4000)
    assert machine.run(body, at[chunk], ends - at[chunk], entry)[1].tolist() == whole.tolist()
