import gzip
import json
import lzma

import numpy as np
import pyarrow as pa
import pytest

from helixframe.functions import filters
from helixframe.sources import fastx, sinks
from helixframe.streaming import counting as stream

FASTQ = "@a\nACGT\n+\nIIII\n\n@b x\nGG\n+b\n##\n"
FASTA = ">one\nACG\nT\n>two\n\n>three\nGGG"


def zstd(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def test_formats_and_codecs(spark, tmp_path):
    paths = []
    for name, data in (("a.fq", FASTQ.encode()), ("b.fq.gz", gzip.compress(FASTQ.encode())), ("c.fq.xz", lzma.compress(FASTQ.encode())), ("d.zst", zstd(FASTQ.encode())), ("e.fa", FASTA.encode()), ("f.fq", b"")):
        (tmp_path / name).write_bytes(data)
        paths.append(str(tmp_path / name))
    rows = sorted(tuple(r) for r in fastx.read_fastx(spark, paths).drop("path").collect())
    assert [r for r in rows if r[0] < 4] == [(f, i, *x) for f in range(4) for i, x in enumerate([("ACGT", "IIII"), ("GG", "##")])]
    assert [r[2] for r in rows if r[0] == 4] == ["ACGT", "", "GGG"] and all(r[0] < 5 for r in rows)
    ids = [r.read_id for r in fastx.reads_of(fastx.read_fastx(spark, paths)).collect()]
    assert len(set(ids)) == len(rows)
    with pytest.raises(ValueError):
        fastx.read_fastx(spark, [])


@pytest.mark.parametrize("data,why", [(b"hello\n", "neither"), (b"@a\nACGT\n+\nIII\n", "differ"), (b"@a\nACGT\n+\n", "cut"), (b"@a\nAC\nxx\nII\n", "third line"), (gzip.compress(FASTQ.encode() * 50)[:-12], "record")])
def test_broken_files(spark, tmp_path, data, why):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(Exception, match=why) as caught:
        fastx.read_fastx(spark, [str(tmp_path / "x")]).collect()
    assert "x, record" in str(caught.value)


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        fastx.read_fastx(spark, [str(tmp_path / "nowhere")]).collect()


def test_sample_sheet(spark, tmp_path):
    (tmp_path / "sheet").write_text("s1 a.fq  b.fq\n\ns2\tc.fq\n")
    assert sorted(tuple(r) for r in fastx.sample_sheet(spark, str(tmp_path / "sheet")).collect()) == [("s1", 0, "a.fq"), ("s1", 1, "b.fq"), ("s2", 0, "c.fq")]
    (tmp_path / "bad").write_text("alone\n")
    with pytest.raises(Exception, match="no file behind sample alone"):
        fastx.sample_sheet(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("compress", [False, True])
def test_fasta(spark, tmp_path, compress):
    df = spark.createDataFrame([("A" * 160,), ("C" * 81,), ("G" * 80,), ("T" * 10,)], "seq string").repartition(3)
    assert sinks.write_fasta(df, 80, str(tmp_path / "out"), compress) == 3
    made = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    text = b"".join(p.read_bytes() for p in made)
    text = (gzip.decompress(text) if compress else text).decode()
    assert text == f">0\n{'A' * 80}\n{'A' * 80}\n>1\n{'C' * 80}\nC\n>2\n{'G' * 80}\n"


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "ACGTA", 3, 2.0), (2, "TACCC", 3, 4.0)], "nid long, seq string, n_kmers long, cov double")
    edges = spark.createDataFrame([(1, "+", 2, "+"), (2, "-", 1, "-")], "src long, so string, dst long, do string")
    made = sinks.write_graph(nodes, edges, 3, str(tmp_path / "a.b"))
    assert [m.rsplit("/", 1)[1] for m in made] == ["a.b.dot", "a.b.gfa", "a.b.gfa2"]
    lines = {m: spark.read.text(m).collect() for m in made}
    gfa = [r.value for r in lines[made[1]]]
    assert gfa == ["H\tVN:Z:1.1", "S\t1\tACGTA\tLN:i:5\tKC:i:6", "S\t2\tTACCC\tLN:i:5\tKC:i:12", "L\t1\t+\t2\t+\t2M"]
    assert "E\t*\t1+\t2+\t3\t5$\t0\t2\t*" in [r.value for r in lines[made[2]]]
    assert sum("->" in r.value for r in lines[made[0]]) == 2


def test_reports(tmp_path):
    h = np.zeros(8000, np.int64)
    h[:6] = [50, 5, 9, 20, 8, 1]
    sinks.write_spectrum_tsv(h, str(tmp_path / "s.tsv"))
    lines = (tmp_path / "s.tsv").read_text().splitlines()
    assert lines[0] == "count\tdistinct" and lines[1:] == [f"{c}\t{n}" for c, n in enumerate([50, 5, 9, 20, 8, 1], 1)]
    made = sinks.write_spectrum_plots(h, {"valley": 2, "peak": 4}, str(tmp_path / "p.q"))
    assert [m.rsplit("/", 1)[1] for m in made] == ["p.q.svg", "p.q.png", "p.q_log.svg", "p.q_log.png"] and open(made[1], "rb").read(8) == b"\x89PNG\r\n\x1a\n" and "peak 4" in open(made[0]).read()
    info = json.loads(sinks.preprocessing_json(93, h, 2, 21, True))
    assert len(info["histo"]) == 500 and info["multik"] and info["used_min_count"] == 2
    assert sinks.step_name("o", 21, False) == "o_k21_contigs.fasta" and sinks.spectrum_name("o", 21, 20, True) == "o_k21_kmerspectrum_q20_log"
    log = sinks.run_log(str(tmp_path / "log"))
    log.info("hello")
    assert "hello" in (tmp_path / "log").read_text()


def test_saved_filter_layout():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    words = filters.default_words(len(keys))
    buffer = np.zeros(words, np.int64)
    one = np.array([0x123456789ABCDEF0], np.uint64)
    key = int(one[0])
    mixed = ((key ^ (key >> 31)) * 0x85D059AA333121CF) % (1 << 64)
    assert filters.location(one, words)[0] == (mixed * words) >> 64
    filters.add(buffer, keys)
    assert filters.holds(buffer, keys).all()
    fresh = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert filters.holds(buffer, fresh).mean() < 0.1
    used, total = filters.occupancy(buffer)
    assert total == words * 64 and 0 < used <= 5 * len(keys)


def test_streamed_counts(spark, tmp_path):
    rows = [(1, "s", "ACGTACG", "IIIIIII", "2031-01-01 00:00:00"), (2, "s", "ACGTTTT", None, "2031-01-02 00:00:00")]
    for i, row in enumerate(rows + rows[:1]):
        spark.createDataFrame([row], "read_id long, sample string, seq string, qual string, loaded_at string").selectExpr("read_id", "sample", "seq", "qual", "cast(loaded_at as timestamp) loaded_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = stream.once_within(stream.reads_stream(spark, str(tmp_path / "in")))
    query = stream.to_memory(stream.running_counts(reads, 3), "counts", "complete")
    got = {r.kmer: r.n for r in spark.sql("select * from counts").collect()}
    from brute import counts

    assert got == dict(counts([r[:1] + r[2:4] for r in rows], 3))
    query.stop()
    stream.to_memory(stream.arrivals(stream.reads_stream(spark, str(tmp_path / "in"))), "loads", "complete").stop()
    assert spark.sql("select sum(reads) from loads").first()[0] == 3


def test_command_line(tmp_path):
    from helixframe.__main__ import main, options_of, parser

    a = parser().parse_args(["x.fq", "-o", str(tmp_path / "o"), "--ks", "21,31", "--min-count", "3"])
    assert options_of(a).ks == (21, 31) and options_of(a).min_count == 3 and options_of(a).pop_ratio == 0.1
    assert main(["x.fq", "-o", str(tmp_path / "o"), "-k", "20"]) == 2
    with pytest.raises(SystemExit):
        main(["-o", "x"])
    assert main(["x.fq", "-o", str(tmp_path / "o"), "--two-bit", "--ks", "21", "--min-quality", "0", "--debug-floors"]) == 2
    assert parser().parse_args(["x.fq", "-o", "o", "--threads", "3"]).threads == 3
    for bad in ("0", "-1", "two"):
        with pytest.raises(SystemExit):
            parser().parse_args(["x.fq", "-o", "o", "--threads", bad])


def test_command_line_run(spark, tmp_path):
    from brute import genome, rc, shotgun
    from helixframe.__main__ import main

    text = genome(400, 31)
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.writelines(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in shotgun(text, 150, 80, 32))
    out = tmp_path / "made" / "a.b"
    assert main([str(tmp_path / "r.fastq.gz"), "-o", str(out), "--ks", "21,31", "--min-contig-length", "200", "--graph", "--debug-floors", "--threads", "8"]) == 0
    names = {p.name for p in out.parent.iterdir()}
    assert {"a.b_contigs.fasta", "a.b_k21_contigs.fasta", "a.b.log", "a.b.gfa", "a.b_k21_kmerspectrum.spectrum.tsv", "a.b_k31_kmerspectrum_q0.png"} <= names
    fasta = "".join(p.read_text() for p in (out.parent / "a.b_contigs.fasta").glob("part*"))
    seq = "".join(fasta.splitlines()[1:])
    assert fasta.startswith(">0\n") and (seq in text or rc(seq) in text) and len(seq) > 350


def test_stepwise(spark):
    from brute import genome, rc, shotgun
    from helixframe.plans.options import AssemblyOptions
    from helixframe.plans.stepwise import Stepwise

    text = genome(400, 41)
    reads = spark.createDataFrame(shotgun(text, 150, 80, 42), "read_id long, seq string, qual string")
    run = Stepwise(reads, AssemblyOptions(min_count=2, min_contig_length=200))
    assert run.take_contigs() is None and run.take_graph() is None
    assert not run.set_pop_ratio(2.0) and not run.set_k(20) and not run.set_dead_end_k_multiple(-1.0) and not run.set_many_ks([31, 21]) and run.options.k is None
    assert run.set_pop_ratio(0.2) and run.set_k(21) and run.options.pop_ratio == 0.2 and run.options.k == 21
    info = json.loads(run.preprocess())
    assert info["k"] == 21 and not info["multik"] and info["used_min_count"] == 2 and len(info["histo"]) == 500 and info["nkmers"] >= 350
    assert json.loads(run.assemble()) == {"ncontigs": 1}
    seq = run.take_contigs().first().seq
    assert (seq in text or rc(seq) in text) and run.take_contigs() is None
    assert any(r.value.startswith("S\t") for r in run.take_graph().collect()) and run.take_graph() is None
