import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import exact_dedup as E
from pyspark.sql import functions as F


def brute(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), p in zip(rows, plain):
        groups[p].append(i)
    out = []
    for (i, _), p in zip(rows, plain):
        ids = [x for x in groups[p] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[p]), i == keep, hashlib.sha256(p.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("k", [0, 1, 7, 40])
def test_rice_codes_round_trip(k):
    values = np.unique(np.random.default_rng(k).integers(0, 1 << (k + 6), 300).astype(np.uint64))
    assert np.array_equal(E.rice_decode(E.rice_encode(values, k)), values)


def test_rice_codes_cost_little_more_than_their_bits():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 1 << 16).astype(np.uint64))
    assert len(E.rice_encode(values, 16)) * 8 / len(values) < 16 + 2.5


def test_hard_cases(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(E.exact_groups(hard)) == brute(rows)


def test_random_texts_with_a_hot_group(table):
    rng = random.Random(5)
    rows = [(k, "hot text" if k % 3 == 0 else rng.choice(["a b", "a  b", "x", "y\tz", f"t{k % 40}"])) for k in range(900)]
    assert got(E.exact_groups(table(rows), owner_rows=20, frame_rows=50)) == brute(rows)


def test_false_suspects_are_cleared(table):
    """Fingerprints of a few bits clash all the time; the bytes decide."""
    rows = [(k, f"text {k % 500}") for k in range(700)]
    assert got(E.exact_groups(table(rows), spare_bits=0)) == brute(rows)


def test_equal_digests_of_different_texts(table, monkeypatch):
    monkeypatch.setattr(E, "_digest", lambda plain: F.unhex(F.substring(F.sha2(plain.cast("binary"), 256), 1, 2)).cast("binary"))
    monkeypatch.setattr(E, "_send", lambda exchange, kind, send=E._send: _padded(send, exchange, kind))
    rows = [(k, f"text {k % 300}") for k in range(450)]
    want = [r[:4] for r in brute(rows)]
    assert sorted((r[:4] for r in got(E.exact_groups(table(rows)))), key=repr) == sorted(want, key=repr)


def _padded(send, exchange, kind):
    import pyarrow as pa

    def run(batches):
        def longer():
            for b in batches:
                sha = pa.array([x.ljust(8, b"\0") for x in b.column("sha").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sha], ["doc_id", "sha"])

        for b in send(exchange, kind)(longer()):
            k = b.schema.get_field_index("sha")
            yield b.set_column(k, "sha", pa.array([None if x is None else x[:1] for x in b.column("sha").to_pylist()], pa.binary()))

    return run


def test_dedup_keeps_columns_and_one_row_each(hard):
    kept = E.exact_dedup(hard)
    assert kept.columns == hard.columns
    rows = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:30]) for r in kept.collect())
    assert [r[0] for r in rows] == [-1, 1, 3, 4, 5, 5, 6, 8]


def test_empty_table(nothing):
    assert E.exact_groups(nothing).count() == 0
    assert E.exact_dedup(nothing).count() == 0


def test_nothing_is_defined_twice():
    import ast
    import inspect

    from plumbline.llm import exact_dedup

    names = [x.name for x in ast.parse(inspect.getsource(exact_dedup)).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
    assert len(names) == len(set(names))
