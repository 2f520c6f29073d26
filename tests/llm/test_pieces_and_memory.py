import zlib
from collections import Counter

import pyarrow as pa
from test_resample import features

from tabeval.llm import common, resample


def test_ngrams_over_pieces():
    """A run of n words may begin with the first word that is kept of the piece before."""
    for texts, n in ((["9.9.9"], 2), (["a b c d e f a b c"], 3), ([None, "x", "x y z x y"], 4)):
        found = Counter()
        for _, number, crc in resample.Ngrams(n, 1).of(texts):
            found.update(zip(number.tolist(), crc.tolist()))
        assert found == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in features(t, n)[0])


def test_lean_tasks_return_what_they_made_and_then_their_memory():
    ended = []

    def run(batches):
        held = [b for b in batches]
        yield from held
        ended.append(True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["a"])
    assert list(common.lean(run)([batch, batch])) == [batch, batch] and ended
