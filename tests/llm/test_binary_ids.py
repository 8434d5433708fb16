import zlib

import numpy as np
import pytest
from pyarrow import fs

from reasonloom.llm import binary_ids, queries
from reasonloom.session import scratch_path
from llm.test_packing import plain_ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, np.uint64).astype("<u4")
        planes = binary_ids.to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4)
        assert (binary_ids.from_planes(planes, n, bits) == ids).all()


def wanted_rows(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = plain_ids(text, 2)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, small_dir, small_documents):
    got = sorted(tuple(r) for r in queries.op7_binary_ids(spark, small_dir).collect())
    documents = small_documents.orderBy("doc_id").select("doc_id", "text").collect()
    assert got == wanted_rows(documents)


@pytest.mark.parametrize("bits", [False, True])
def test_small_chunks_and_single_chunks(spark, small_documents, bits):
    folder = scratch_path(spark, "planes")
    cfg = binary_ids.BinaryConfig(queries.TOKENIZER, chunk_ids=100, bits=bits)
    manifest = binary_ids.write_ids(small_documents, folder, cfg).collect()
    rows = small_documents.orderBy("doc_id").select("doc_id", "text").collect()
    assert sorted(map(tuple, binary_ids.read_ids(spark, folder).collect())) == wanted_rows(rows)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{manifest[0]['file']}") as source:
        reader = binary_ids.PlaneReader(source)
        whole = np.concatenate([plain_ids(r.text, 2) for r in rows])
        for k in (3, 0, len(reader.chunks) - 1):
            part = whole[k * 100 : min((k + 1) * 100, manifest[0]["n_ids"])]
            assert (reader.chunk(k) == part).all()


def test_odd_rows(spark, odd_documents):
    folder = scratch_path(spark, "planes")
    cfg = binary_ids.BinaryConfig(queries.TOKENIZER)
    binary_ids.write_ids(odd_documents, folder, cfg)
    rows = sorted(binary_ids.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][:2] == [None, None]
    assert [r.doc_id for r in rows][2:] == sorted(r.doc_id for r in odd_documents.collect() if r.doc_id)
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1]]
    empty = scratch_path(spark, "planes")
    binary_ids.write_ids(odd_documents.limit(0), empty, cfg)
    assert binary_ids.read_ids(spark, empty).count() == 0
