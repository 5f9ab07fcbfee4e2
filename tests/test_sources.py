"""Readers, contracts and sinks on small files."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from measurelake import contracts, model
from measurelake.operators import relational
from measurelake.sources import readers, sinks
from measurelake.streaming import contrasts


def write(path, text):
    path.write_text(text)
    return str(path)


def test_strict_matrix(spark, tmp_path):
    good = write(tmp_path / "a.tsv", "probe\ts1\ts2\ncg1\t0.2\tNA\ncg2\t0.5\t1.0\n")
    got = {(r.probe, r.sample): r.beta for r in readers.strict_matrix(spark, good).collect()}
    assert got == {("cg1", "s1"): 0.2, ("cg1", "s2"): None, ("cg2", "s1"): 0.5, ("cg2", "s2"): 1.0}
    for bad in ("bad", "1.1", "Inf", "-.1"):
        with pytest.raises(contracts.ContractError):
            readers.strict_matrix(spark, write(tmp_path / f"{bad}.tsv", f"probe\ts1\ncg1\t{bad}\n"))
    with pytest.raises(contracts.ContractError):
        readers.strict_matrix(spark, write(tmp_path / "d.tsv", "probe\ts1\ts1\ncg1\t0.1\t0.2\n"))
    with pytest.raises(contracts.ContractError):
        readers.strict_matrix(spark, write(tmp_path / "e.tsv", "probe\ts1\ncg1\t0.1\ncg1\t0.2\n"))


def test_cohort_alignment(spark, tmp_path):
    matrix = readers.strict_matrix(spark, write(tmp_path / "m.tsv", "probe\ts2\ts1\ncg1\t0.7\t0.2\n"))
    samples = spark.createDataFrame([("s1", "p", "N"), ("s2", "p", "T")], "sample string, patient string, tissue string")
    joined = readers.load_cohort(matrix, samples)
    delta = relational.paired_differences(joined, ["patient", "probe"], "tissue", "beta", "T", "N").first().delta
    assert delta == pytest.approx(0.5)
    with pytest.raises(contracts.ContractError):
        readers.load_cohort(matrix, samples.filter("sample = 's1'"))
    with pytest.raises(contracts.ContractError):
        readers.load_cohort(matrix, samples.union(samples))


def test_series_matrix(spark, tmp_path):
    text = '!Series_title\t"x"\n!Sample_geo_accession\t"G1"\t"G2"\n!Sample_characteristics_ch1\t"tissue: T"\t"tissue: N"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"cg1"\t0.1\t0.2\n"cg2"\t\t0.4\n!series_matrix_table_end\n'
    meta, table = readers.read_series_matrix(spark, write(tmp_path / "s.txt", text), ["cg1", "cg2"])
    assert {tuple(r) for r in meta.collect()} == {("G1", "tissue", "T"), ("G2", "tissue", "N")}
    assert {tuple(r) for r in table.collect()} == {("cg1", "G1", 0.1), ("cg1", "G2", 0.2), ("cg2", "G1", None), ("cg2", "G2", 0.4)}


def test_zip_annotation_manifest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "cg1\t0.1\ncg2\t0.2\ncg9\t0.9\n")
        z.writestr("b.txt", "cg2\t0.3\n")
    got = {tuple(r) for r in readers.read_zip_members(spark, str(tmp_path / "z.zip"), ["cg1", "cg2"]).collect()}
    assert got == {("a.txt", "cg1", "0.1"), ("a.txt", "cg2", "0.2"), ("b.txt", "cg2", "0.3")}
    gpl = write(tmp_path / "g.txt", "#c\nID\tGene Symbol\np1\tABC /// ABC\np2\tABC;XYZ\np3\txyz\n")
    assert {tuple(r) for r in readers.read_annotation(spark, gpl, "ID", "Gene Symbol", ["ABC", "XYZ"]).collect()} == {("p1", "ABC"), ("p3", "XYZ")}
    (tmp_path / "files").mkdir()
    write(tmp_path / "files" / "x", "1")
    found = readers.file_manifest(spark, str(tmp_path / "files"))
    expected = spark.createDataFrame([("x", "0" * 64), ("y", "0" * 64)], "name string, sha256 string")
    assert {tuple(r) for r in readers.manifest_differences(found, expected).collect()} == {("x", "changed"), ("y", "missing")}


def test_audited_scan(spark, tmp_path):
    """Every defect is counted over all lines, kept or not; the digest does not depend on order or files."""
    lines = ["p\ta\tb", "k1\t0.1\tNA", "k2\t0.2", "k1\t0.3\tx", "k3\tInf\t1"]
    (tmp_path / "m").mkdir()
    write(tmp_path / "m" / "1.tsv", "\n".join(lines) + "\n")
    targets = spark.createDataFrame([("k1",), ("k9",), ("k1",)], "key string")
    kept, audit = readers.audited_scan(spark, str(tmp_path / "m"), targets, str(tmp_path / "kept"))
    assert sorted((r.key, tuple(r.cells), r.n_lines) for r in kept.collect()) == [("k1", ("k1", "0.1", "NA"), 2), ("k1", ("k1", "0.3", "x"), 2)]
    assert (audit.lines, audit.characters, audit.ragged, audit.bad_tokens) == (4, sum(map(len, lines[1:])), 1, 2)
    assert len(audit.problems({"lines": 5, "digest": audit.digest})) == 3
    (tmp_path / "n").mkdir()
    write(tmp_path / "n" / "1.tsv", "\n".join([lines[0], lines[4], lines[2]]) + "\n")
    write(tmp_path / "n" / "2.tsv", "\n".join([lines[0], lines[3], lines[1]]) + "\n")
    again = readers.audited_scan(spark, str(tmp_path / "n"), targets, str(tmp_path / "kept2"))[1]
    assert again == audit
    write(tmp_path / "n" / "2.tsv", "\n".join([lines[0], lines[3], lines[3]]) + "\n")
    assert readers.audited_scan(spark, str(tmp_path / "n"), targets, str(tmp_path / "kept3"))[1].digest != audit.digest
    write(tmp_path / "e.tsv", "p\ta\n")
    empty, seen = readers.audited_scan(spark, str(tmp_path / "e.tsv"), targets, str(tmp_path / "kept4"))
    assert empty.count() == 0 and seen == readers.Audit(0, 0, 0, 0, "0")
    none, seen = readers.audited_scan(spark, str(tmp_path / "m"), targets.limit(0), str(tmp_path / "kept5"))
    assert none.count() == 0 and seen == audit


def test_source_guard(spark, tmp_path):
    """Files of one name in two folders are two files."""
    for folder in ("a", "b"):
        (tmp_path / "src" / folder).mkdir(parents=True)
        write(tmp_path / "src" / folder / "x.txt", folder)
    guard = readers.SourceGuard(spark, str(tmp_path / "src"), str(tmp_path / "manifest"))
    guard.verify()
    write(tmp_path / "src" / "b" / "x.txt", "changed")
    write(tmp_path / "src" / "b" / "y.txt", "new")
    assert {tuple(r) for r in guard.differences().collect()} == {("b/x.txt", "changed"), ("b/y.txt", "unlisted")}
    with pytest.raises(contracts.ContractError):
        guard.verify()


def test_json_is_strict(spark, tmp_path):
    write(tmp_path / "a.json", '{"x": 1.5}\n{"x": null}\n')
    assert [r.x for r in readers.read_json(spark, str(tmp_path / "a.json"), "x double").collect()] == [1.5, None]
    for bad in ("NaN", '"one"', "["):
        write(tmp_path / "b.json", f'{{"x": {bad}}}\n')
        with pytest.raises(Exception):
            readers.read_json(spark, str(tmp_path / "b.json"), "x double").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, None)], "a int, b double")
    assert sinks.write_small_gzip(df, str(tmp_path / "t.gz"), ["a"]) == sinks.write_small_gzip(df, str(tmp_path / "u.gz"), ["a"])
    assert sinks.to_markdown(df, ["a"]).splitlines()[2:] == ["| 1 |  |", "| 2 | 0.5 |"]
    with pytest.raises(ValueError):
        sinks.write_json({"x": float("nan")}, str(tmp_path / "n.json"))
    first = sinks.keyed_checkpoint(df, str(tmp_path / "k"), {"v": 1})
    assert first.count() == 2 and sinks.keyed_checkpoint(df.limit(0), str(tmp_path / "k"), {"v": 1}).count() == 2


def test_restore(tmp_path):
    (tmp_path / "p").mkdir()
    data = b"x"
    (tmp_path / "p" / "f").write_bytes(data)
    row = {"package_path": "f", "source_path": "d/f", "sha256": hashlib.sha256(data).hexdigest()}
    assert sinks.restore([row], str(tmp_path / "p"), str(tmp_path / "t")) == [str(tmp_path / "t" / "d" / "f")]
    for bad in ({"source_path": "../f"}, {"package_path": "/etc/passwd"}, {"sha256": "0" * 64}):
        with pytest.raises(contracts.ContractError):
            sinks.restore([row | bad], str(tmp_path / "p"), str(tmp_path / "t2"))
    (tmp_path / "t" / "d" / "f").write_bytes(b"y")
    with pytest.raises(contracts.ContractError):
        sinks.restore([row], str(tmp_path / "p"), str(tmp_path / "t"))


def test_registry_order(spark):
    rows = model.registry_rows(spark, {"G": ["b", "a"], "H": ["c"]}).orderBy("gene", "gene_probe_index").collect()
    assert [tuple(r) for r in rows] == [("G", 0, "b"), ("G", 1, "a"), ("H", 0, "c")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "cohort int, patient int, tissue string, probe int, beta double")
    assert relational.paired_differences(empty, ["patient"], "tissue", "beta", "T", "N").count() == 0
    assert contracts.key_difference(empty, empty, ["patient"]).count() == 0


def test_pairs_are_verified(spark):
    """A second specimen of an arm is no pair, whichever value is larger."""
    df = spark.createDataFrame([(1, "T", 0.5), (1, "N", 0.2), (2, "T", 0.5), (2, "T", 0.4), (2, "N", 0.1), (3, "T", 0.5), (3, "N", None), (4, "T", 0.1)], "p int, t string, v double")
    got = relational.paired_differences(df, ["p"], "t", "v", "T", "N")
    assert got.columns == ["p", "high", "low", "delta"] and [r.p for r in got.collect()] == [1]
    assert {r.p for r in relational.verify_pairs(df, ["p"], "t", "T", "N").filter("pair_verified").collect()} == {1, 3}


def test_one_hot_without_constants(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    assert relational.one_hot(df, "x", "x", ["a", "b", "c"]).columns == ["x", "x_b", "x_c"]
    assert relational.one_hot(df, "x", "x", ["a", "b", "c"], drop_constants=True).columns == ["x", "x_b"]


def test_pair_repair(spark):
    df = spark.createDataFrame([("CC01",), ("NCC01",), ("CC02",)], "title string")
    got = {r.title: r.paired for r in relational.repair_pairs(df, "title", r"^CC(\d+)$", r"^NCC(\d+)$").collect()}
    assert got == {"CC01": True, "NCC01": True, "CC02": False}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", 0.2), (1, "2024-01-01 05:00:00", 0.4)], "probe int, ts string, beta double").select("probe", F.to_timestamp("ts").alias("ts"), "beta").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("probe int, ts timestamp, beta double").parquet(str(tmp_path / "in"))
    q = contrasts.windowed_means(stream, ["probe"], "ts", "beta").writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, round(r["mean"], 6)) for r in spark.table("means").collect()] == [(2, 0.3)]
