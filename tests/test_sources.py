"""Sources, sink and file-level operators on real files."""

import glob
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from reasonloom.operators import curate
from reasonloom.sources import files, paths, readers, sink

FULL = "problem string, generated_solution string, problem_type string, pass_rate_72b_tir string"


def good(n, rate="0.9", text="a b"):
    return [(f"p{i}", text, "has_answer_extracted", rate) for i in range(n)]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="reasonloom-test-")


@pytest.fixture
def put(spark, folder):
    """Write rows as one Parquet file of a given relative name."""

    def write(name, rows, schema=FULL):
        made = tempfile.mkdtemp(prefix="reasonloom-part-")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(made)
        target = os.path.join(folder, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copy(glob.glob(f"{made}/*.parquet")[0], target)
        return target

    return write


def junk(folder, name="bad.parquet"):
    with open(os.path.join(folder, name), "w") as out:
        out.write("junk")


def test_folder_with_good_empty_corrupt_and_foreign_files(spark, folder, put):
    put("b.parquet", good(2))
    put("a.parquet", good(3))
    put("empty.parquet", [])
    put("sub/below.parquet", good(7))
    junk(folder)
    junk(folder, "notes.txt")
    with pytest.raises(Exception):
        readers.read_parquet_dir(spark, folder).count()
    rows = readers.read_parquet_dir(spark, folder, skip_corrupt=True)
    assert rows.count() == 5
    skipped = {os.path.basename(r.path) for r in readers.skipped_files(spark, folder).collect()}
    assert skipped == {"bad.parquet", "empty.parquet"}
    with_files = readers.with_source_file(rows, folder)
    offsets = {r.source_file: (r.n_rows, r.row_offset) for r in files.file_offsets(with_files).collect()}
    assert offsets == {"a.parquet": (3, 0), "b.parquet": (2, 3)}


def test_a_corrupt_file_alone_fails_without_the_option(spark, folder):
    junk(folder)
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()
    assert readers.read_parquet_dir(spark, folder, skip_corrupt=True).count() == 0
    assert readers.read_parquet_file(spark, f"{folder}/bad.parquet", skip_corrupt=True).count() == 0
    assert readers.skipped_files(spark, folder).count() == 1
    with pytest.raises(Exception):
        readers.read_parquet_dir(spark, folder).count()


def test_a_damaged_file_is_used_whole_or_not_at_all(spark, folder, put):
    put("good.parquet", good(3))
    rows = [(f"{i} " * 40, "x " * (i % 50), "has_answer_extracted", "0.9") for i in range(4000)]
    path = put("torn.parquet", rows)
    with open(path, "r+b") as torn:  # a page in the middle, the footer stays
        torn.seek(os.path.getsize(path) // 2)
        torn.write(b"\x00" * 4000)
    with pytest.raises(Exception):
        readers.read_parquet_dir(spark, folder).select(F.max(F.xxhash64("*"))).collect()
    kept = readers.read_parquet_dir(spark, folder, skip_corrupt=True)
    assert kept.count() == 3 and kept.select(F.max(F.xxhash64("*"))).count() == 1
    left_out = readers.skipped_files(spark, folder).collect()
    assert [(os.path.basename(r.path), r.rows_promised) for r in left_out] == [("torn.parquet", 4000)]
    assert left_out[0].rows_read < 4000
    out = tempfile.mkdtemp(prefix="reasonloom-out-")
    curate.curate_files(spark, folder, out, skip_corrupt=True)
    assert spark.read.parquet(out).count() == 3


def test_empty_folder_is_an_empty_corpus(spark, folder):
    rows = readers.read_parquet_dir(spark, folder)
    assert rows.isEmpty() and rows.columns == list(readers.CORPUS_COLUMNS)


def test_json_lines(spark, folder):
    lines = [
        '{"problem": "p", "generated_solution": "s"}', "{bad", "", "123", '{"problem": "q"}',
        '{"problem": "first", "problem": "last"}', "[1,2]",
    ]
    path = f"{folder}/x.jsonl"
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    rows, bad = readers.read_jsonl(spark, path)
    assert sorted(r.problem for r in rows.collect()) == ["last", "p", "q"]
    assert sorted(r.value for r in bad.collect()) == sorted(["{bad", "", "123", "[1,2]"])
    assert tuple(readers.count_jsonl(spark, path).first()) == (3, 4)
    assert readers.read_corpus(spark, path).count() == 3


def test_dispatch(spark, folder, put):
    file = put("x.parquet", good(4))
    assert readers.read_corpus(spark, folder).count() == 4
    assert readers.read_corpus(spark, file).count() == 4
    put("y.jsonl/x.parquet", good(2))  # a folder comes first, whatever its name
    assert readers.read_corpus(spark, f"{folder}/y.jsonl").count() == 2
    with pytest.raises(ValueError):
        readers.read_corpus(spark, f"{folder}/x.csv")


def test_discovery(spark, folder, put):
    put("one/x.parquet", good(1))
    put("two/x.parquet", good(2))
    found = readers.discover(spark, folder)
    assert found.count() == 3
    names = readers.with_source_file(found, folder).select("source_file").distinct().collect()
    assert {r.source_file for r in names} == {"one/x.parquet", "two/x.parquet"}
    put("top.parquet", good(4))
    assert readers.discover(spark, folder).count() == 4


def test_split_and_glob(spark, folder, put):
    put("cot-00000-of-00002.parquet", good(1))
    put("cot-00001-of-00002.parquet", good(2))
    put("tir-00000-of-00001.parquet", good(4))
    assert readers.read_split(spark, folder, "cot").count() == 3
    assert readers.read_glob(spark, f"{folder}/*-00000-*.parquet").count() == 5


def test_odd_characters_in_paths(spark, folder, put):
    names = {"c d+e.parquet", "p%20q.parquet", "\u00fc.parquet"}
    for name in names:
        put(f"a b+c%20d/{name}", good(1))
    root = f"{folder}/a b+c%20d"
    rows = readers.with_source_file(readers.read_parquet_dir(spark, root), root)
    assert {r.source_file for r in rows.collect()} == names
    assert readers.skipped_files(spark, root).isEmpty()


def test_files_with_different_columns(spark, folder, put):
    put("full.parquet", good(3) + good(2, rate="0.1") + good(1, rate=None))
    put("norate.parquet", [r[:3] for r in good(4)], FULL.rsplit(",", 1)[0])
    put(
        "notext.parquet",
        [("x " * 9000, "has_answer_extracted", "0.9"), ("x", "has_answer_extracted", "0.2")],
        "generated_solution string, problem_type string, pass_rate_72b_tir string",
    )
    put("dropped.parquet", good(2, rate="0.0"))
    junk(folder)
    out = tempfile.mkdtemp(prefix="reasonloom-out-")
    curate.curate_files(spark, folder, out, skip_corrupt=True)
    kept = spark.read.parquet(out)
    got = {r.source_file: r["count"] for r in kept.groupBy("source_file").count().collect()}
    assert got == {"full.parquet": 3, "norate.parquet": 4, "notext.parquet": 1}
    rows = kept.collect()
    assert all(r.pass_rate_72b_tir is None for r in rows if r.source_file == "norate.parquet")
    assert all(r.problem is None for r in rows if r.source_file == "notext.parquet")
    assert not any("absent" in str(v) for r in rows for v in r)
    funnel = {r.source_file: tuple(r)[1:] for r in curate.funnel(curate.read_files(spark, folder, skip_corrupt=True)).collect()}
    assert funnel["full.parquet"] == (6, 6, 3, 3)
    assert funnel["norate.parquet"] == (4, 4, 4, 4)
    assert funnel["notext.parquet"] == (2, 2, 1, 1)
    assert funnel["dropped.parquet"] == (2, 2, 0, 0)


def test_pass_rates_of_differing_types(spark, folder, put):
    put("text.parquet", good(2) + good(1, rate="0.1"))
    put("number.parquet", [(*r[:3], 0.9) for r in good(3)] + [(*r[:3], 0.1) for r in good(4)],
        FULL.rsplit(",", 1)[0] + ", pass_rate_72b_tir double")
    put("absent.parquet", [r[:3] for r in good(5)], FULL.rsplit(",", 1)[0])
    kept = curate.curate(curate.read_files(spark, folder))
    got = {r.source_file: r["count"] for r in kept.groupBy("source_file").count().collect()}
    assert got == {"text.parquet": 2, "number.parquet": 3, "absent.parquet": 5}


def test_corpus_whose_first_file_lacks_a_column(spark, folder, put):
    put("a.parquet", [("p", "has_answer_extracted")], "problem string, problem_type string")
    put("b.parquet", good(2))
    rows = readers.read_corpus(spark, folder)
    assert rows.count() == 3
    assert sorted(str(r.generated_solution) for r in rows.collect())[0] == "None"


def test_other_json_columns_are_kept(spark, folder):
    path = f"{folder}/x.jsonl"
    with open(path, "w") as out:
        out.write('{"problem": "p", "level": 3, "tags": ["a"]}\n{"problem": "q", "note": "n"}\n{oops\n')
    rows = readers.read_corpus(spark, path)
    got = {r.problem: (r.level, r.tags, r.note) for r in rows.collect()}
    assert got == {"p": ("3", '["a"]', None), "q": (None, None, "n")}


def test_column_absent_everywhere(spark):
    rows = spark.createDataFrame([r[:3] for r in good(2)], FULL.rsplit(",", 1)[0])
    assert curate.curate(rows).count() == 2
    with pytest.raises(ValueError):
        curate.curate(rows.drop("problem_type"))


@pytest.mark.parametrize("bad", [{"max_len": 0}, {"pass_rate": 1.1}, {"pass_rate": -0.1}])
def test_argument_checks(bad):
    with pytest.raises(ValueError):
        curate.CurateConfig(**bad)


def test_boundaries_of_the_steps(spark):
    rows = spark.createDataFrame(
        [
            ("a", "b " * 9, "has_answer_extracted", "0.8"),
            ("a", "b " * 9, "has_answer_extracted", "0.81"),
            ("a", "b " * 10, "has_answer_extracted", "0.9"),
            (None, None, "has_answer_extracted", "0.9"),
            ("a", "b", None, "0.9"),
            ("a", "b", "no_answer_extracted", "0.9"),
        ],
        FULL,
    )
    kept = curate.curate(rows, curate.CurateConfig(max_len=10)).collect()
    assert [r.pass_rate_72b_tir for r in kept] == ["0.81", "0.9"]


def test_callers_token_counter(spark):
    cfg = curate.CurateConfig(max_len=6, tokenizer=len)
    rows = spark.createDataFrame(good(2, text="abcd") + good(1, text="abcde") + good(1, text=None), FULL)
    assert curate.curate(rows, cfg).count() == 3


@pytest.mark.parametrize("gather", [False, True])
def test_sink_keeps_every_row_of_a_hot_file(spark, folder, gather):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("f/"), F.col("id") % 7)).alias("source_file")
    )
    sink.write_filtered(rows, f"{folder}/out", gather=gather)
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == 3000 and back.filter("source_file = 'hot'").count() == 2000


def test_manifest_and_selection(spark):
    manifest = '{"siblings": [{"rfilename": "data/cot-1.parquet"}, {"rfilename": "README.md"}, {}]}'
    rows = spark.createDataFrame([(1, manifest), (2, None)], "id int, manifest string")
    got = paths.manifest_files(rows).orderBy("path").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("README.md", "", "README.md"), ("data/cot-1.parquet", "data", "cot-1.parquet"),
    ]
    chosen = paths.manifest_files(rows, include=["*.parquet", "*.md"], exclude=["README*"])
    assert [r.name for r in chosen.collect()] == ["cot-1.parquet"]


def test_profile(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "problem string, other string")
    got = files.profile(rows, ("problem", "generated_solution")).collect()
    assert [tuple(r) for r in got] == [
        ("problem", 2, 0), ("other", 2, 1), ("generated_solution", 2, None),
    ]
    assert files.first_row(rows).count() == 1


def rows_of_files(spark, sizes):
    data = [(f"f{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(data, "source_file string, row_in_file long").repartition(5)


def test_global_index(spark):
    rows = rows_of_files(spark, [3, 2, 4])
    indexed = files.with_global_index(rows)
    got = sorted((r.global_idx, r.source_file, r.row_in_file) for r in indexed.collect())
    wanted = [("f0", 0), ("f0", 1), ("f0", 2), ("f1", 0), ("f1", 1)] + [("f2", i) for i in range(4)]
    assert got == [(k, *w) for k, w in enumerate(wanted)]
    assert files.row_at(indexed, 4).select("source_file", "row_in_file").first() == ("f1", 1)
    for idx in (-1, 9):
        with pytest.raises(IndexError):
            files.row_at(indexed, idx)


@pytest.mark.parametrize("seed", [None, 7])
def test_global_index_of_filtered_rows(spark, monkeypatch, seed):
    rows = rows_of_files(spark, [4, 4, 4])
    columns = ["source_file", "row_in_file", "global_idx"]
    whole = sorted(files.with_global_index(rows, seed=seed).select(columns).collect())
    odd = rows.filter("row_in_file % 2 = 1")
    wanted = [r for r in whole if r.row_in_file % 2]
    offsets = files.file_offsets(rows, seed=seed)
    for bits in (20, 1, 0):  # however the files are cut into ranges
        monkeypatch.setattr(files, "CHUNK_BITS", bits)
        got = files.with_global_index(odd, seed=seed, offsets=offsets)
        assert sorted(got.select(columns).collect()) == wanted
        assert sorted(files.with_global_index(odd, seed=seed).select(columns).collect()) == wanted


def test_null_files_keep_their_rows(spark):
    rows = spark.createDataFrame(
        [("a", 0), (None, 0), (None, 1), ("b", 0)], "source_file string, row_in_file long"
    )
    got = files.with_global_index(rows).select("global_idx").collect()
    assert sorted(r[0] for r in got) == [0, 1, 2, 3]
    for count, n in ((1, 1), (2, 2), (3, 3)):
        chosen = files.sample_files(rows, count=count).select("source_file").distinct()
        assert chosen.count() == n


def test_rows_at_reads_only_their_files(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    rows = spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id")
    rows.write.parquet(folder)
    found = files.rows_at(spark, folder, [3, 41, 99])
    assert sorted((r.global_idx, r.id) for r in found.collect()) == [(3, 3), (41, 41), (99, 99)]
    assert len(found.inputFiles()) == 3
    assert files.rows_at(spark, folder, []).count() == 0
    for idx in (-1, 100):
        with pytest.raises(IndexError):
            files.rows_at(spark, folder, [0, idx])


@pytest.mark.parametrize(
    "kwargs, n", [({"count": 2}, 2), ({"count": 99}, 6), ({"ratio": 0.5}, 3), ({"ratio": 0.01}, 1),
                  ({"ratio": 1.0}, 6), ({"ratio": 0.2, "count": 4}, 4)],
)
def test_file_sample_keeps_whole_files(spark, kwargs, n):
    sizes = [50, 1, 5, 2, 9, 3]
    got = files.sample_files(rows_of_files(spark, sizes), **kwargs)
    counts = {r.source_file: r["count"] for r in got.groupBy("source_file").count().collect()}
    assert len(counts) == n
    assert all(sizes[int(name[1:])] == c for name, c in counts.items())


@pytest.mark.parametrize("kwargs", [{}, {"count": 0}, {"ratio": 0.0}, {"ratio": 1.5}])
def test_file_sample_arguments(spark, kwargs):
    with pytest.raises(ValueError):
        files.sample_files(rows_of_files(spark, [1]), **kwargs)


def test_file_sample_golden(spark, medium_dir):
    from reasonloom.plans.reasoning import reasoning

    rows = reasoning(spark, medium_dir)
    for kwargs, n in (({"count": 3}, 3), ({"ratio": 0.1}, 2), ({"count": 50}, 20)):
        got = files.sample_files(rows, **kwargs).groupBy("source_file").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {50}


def test_funnel_golden(spark, medium_dir):
    from reasonloom.plans.reasoning import reasoning

    cfg = curate.CurateConfig(max_len=120)
    rows = curate.funnel(reasoning(spark, medium_dir, 1200), cfg).collect()
    assert [sum(r[c] for r in rows) for c in ("n0", "n1", "n2", "n3")] == [1000, 753, 111, 53]
    assert next(tuple(r)[1:] for r in rows if r.source_file == "src1") == (50, 47, 2, 0)
    for length, n in ((120, 8), (2048, 23)):
        cfg = curate.CurateConfig(max_len=length)
        small = reasoning(spark, "/root/testdata/sf0.001", 1200)
        assert curate.curate(small, cfg).count() == n
