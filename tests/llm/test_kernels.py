import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import alnum, words
from vellum.llm.kernels import ALNUM, NONSPACE, Words, grams, shingle_sets, slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB1é漢 \n\t.-'~\x00", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from([1, 7, 1 << 20]))
def test_words(texts, size):
    for kind, split in ((ALNUM, alnum), (NONSPACE, words)):
        got = []
        for low, high, body, offsets in slices(pa.array(texts, pa.string()), size):
            w = Words(body, offsets, kind)
            found = [w.bytes[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
            got += [found[a:b] for a, b in zip(w.rows, w.rows[1:])]
            hashes = w.hashes()
            assert len({*zip(found, hashes.tolist())}) == len(set(found)) == len(set(hashes.tolist()))
        assert got == [split(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 5))
def test_shingles(texts, n):
    for low, high, body, offsets in slices(pa.array(texts, pa.string())):
        w = Words(body, offsets, NONSPACE)
        values, bounds = shingle_sets(w, n)
        for i, t in enumerate(texts[low:high]):
            own = words(t)
            want = {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()
            part = values[bounds[i] : bounds[i + 1]]
            assert len(part) == len(want) and (np.diff(part.astype(object)) > 0).all()
            assert set(part.tolist()) == {int(grams(Words(b := np.frombuffer(" ".join(s).encode(), np.uint8), np.array([0, len(b)]), NONSPACE).hashes(), len(s))[0]) for s in want}
