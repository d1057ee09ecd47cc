"""Token files: contents against the library, order, encodings, page indexes, selective reads."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from curbflow.llm import token_files
from curbflow.llm.queries import BYTE_BPE

from .conftest import awkward_rows


@pytest.fixture(scope="module")
def expected_ids():
    library = Tokenizer.from_file(BYTE_BPE)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_files_hold_every_document_in_order(spark, awkward, expected_ids, encoding):
    path = token_files.write_tokens(
        awkward, token_files.token_folder(spark), BYTE_BPE, encoding=encoding, page_rows=2
    )
    found = token_files.digests(spark, path).orderBy("start").collect()
    wanted = [(row[0], expected_ids(row[1])) for row in awkward_rows()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(
        (str(d), len(ids), crc(ids)) for d, ids in wanted
    )
    order = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert order == sorted(order)
    assert [r.start for r in found] == np.append(0, np.cumsum([r.n_tokens for r in found]))[:-1].tolist()

    encodings = set()
    for name in glob.glob(f"{path}/tokens/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for group in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                column = meta.row_group(group).column(k)
                assert column.has_offset_index, column.path_in_schema
                if column.path_in_schema == "doc_id":
                    assert column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    encodings.update(column.encodings)
    assert ("DELTA_BINARY_PACKED" in encodings) == (encoding == "delta")
    assert bool({"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & encodings) == (encoding == "dictionary")


def test_selective_reads(spark, expected_ids):
    texts = [(k, f"text number {k} " * (k % 7)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    path = token_files.write_tokens(docs, token_files.token_folder(spark), BYTE_BPE)
    starts, at = {}, 0
    for k, text in texts:
        starts[k] = (at, len(expected_ids(text)))
        at += starts[k][1]
    few = token_files.read_documents(spark, path, "doc_id BETWEEN 40 AND 43").collect()
    assert {r.doc_id: (r.start, r.n_tokens) for r in few} == {k: starts[k] for k in range(40, 44)}
    assert all(list(r.ids) == expected_ids(texts[r.doc_id][1]) for r in few)
    low, high = 500, 777
    span = token_files.read_span(spark, path, low, high).collect()
    assert {r.doc_id for r in span} == {k for k, (a, n) in starts.items() if a < high and a + n > low}
    assert {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_metadata(spark, path).collect()} == starts
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema:", 1)[1].split("\n", 1)[0]


def test_one_id_and_text_for_all_rows_is_split(spark, expected_ids):
    docs = spark.range(4000, numPartitions=8).selectExpr("CAST(7 AS LONG) AS doc_id", "'same text' AS text")
    path = token_files.write_tokens(docs, token_files.token_folder(spark), BYTE_BPE)
    found = token_files.digests(spark, path).collect()
    assert {r.ids_crc32 for r in found} == {crc(expected_ids("same text"))}
    n = found[0].n_tokens
    assert sorted(r.start for r in found) == list(range(0, 4000 * n, n))


def test_tables_without_rows_and_wrong_encoding(spark, nothing):
    path = token_files.write_tokens(nothing, token_files.token_folder(spark), BYTE_BPE)
    assert token_files.digests(spark, path).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(nothing, token_files.token_folder(spark), BYTE_BPE, encoding="plain")
