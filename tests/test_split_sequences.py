"""Split reading against reading whole files, at every size of splits."""

import gzip
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.sources import sequences, split_sequences as S
from seqloom.sources.splits import Split


def fasta(n: int, seed: int, width: int = 60, end: str = "\n") -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 59, 60, 61, 300, 2000])))
        out.append(f">rec{i} a>b >c{end}" + end.join(seq[j : j + width] for j in range(0, len(seq), width)) + (end if seq else "") + (end if i % 7 == 0 else ""))
    return "".join(out)


def fastq(n: int, seed: int) -> str:
    r = random.Random(seed)
    out = ""
    for i in range(n):
        m = r.randint(1, 80)
        out += f"@r{i}\n{''.join(r.choice('ACGT') for _ in range(m))}\n+\n{''.join(r.choice('@+>I!') for _ in range(m))}\n"
    return out


def embl(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(f"ID   X{i}; SV 1;\nXX\nSQ   Sequence\n     {''.join(r.choice('acgt') for _ in range(r.randint(1, 60)))} 60\n//\n" for i in range(n))


def genbank(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(f"LOCUS       G{i} 10 bp\nDEFINITION x\nORIGIN\n        1 {''.join(r.choice('acgt') for _ in range(r.randint(1, 60)))}\n//\n" for i in range(n))


def split_rows(path, size: int, mode: str, piece: int = 1 << 20, overlap: int = 0):
    reader = S.SplitReader({"mode": mode, "paths": str(path), "split": size, "piece": piece, "overlap": overlap})
    return [(p, list(reader.read(p))) for p in reader.partitions()]


@pytest.mark.parametrize("kind,text", [("fasta", fasta(40, 1)), ("crlf", fasta(20, 2, end="\r\n")), ("fastq", fastq(60, 3)), ("embl", embl(40, 4)), ("genbank", genbank(40, 5)), ("blank", "\n\n" + fasta(5, 6)), ("empty", "")])
def test_every_split_size(tmp_path, monkeypatch, kind, text):
    path = tmp_path / "x"
    path.write_bytes(text.encode())
    want = list(sequences.records(iter(text.split("\n"))))
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(S, "CHUNK", chunk)
        for size in (1, 2, 3, 17, 61, 100, 1000, 1 << 20) if len(text) < 5000 else (13, 61, 997, 1 << 20):
            assert [(i, s) for _, rows in split_rows(path, size, "records") for *_, i, s in rows] == want


@pytest.mark.parametrize("text", [fasta(25, 7), fasta(10, 8, end="\r\n"), ">one\n" + "ACGTACGTTA" * 50 + "\n>two >x\nAC", ">a long header > " + "x>" * 100 + "\nACGT\n", ">a\nAC>GT>>A\n>b\n>c\nA>\n>\nC"])
@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_pieces_tile_sequences(monkeypatch, tmp_path, text, chunk):
    """Own bases follow each other without gap or overlap, places are carried over, and what follows is the record's own."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    path = tmp_path / "x.fa"
    path.write_bytes(text.encode())
    want = {i: s for i, (_, s) in enumerate(sequences.records(iter(text.split("\n")))) if s}
    for size, piece, overlap in ((10, 4, 3), (37, 16, 8), (100, 1000, 8), (1 << 20, 33, 0)):
        got: dict = {}
        base, carried = 0, 0
        for _, rows in split_rows(path, size, "pieces", piece, overlap):
            started = tail = 0
            for *_, record, _id, at, own, bases in rows:
                if not own:
                    started, tail = started + 1, 0
                    continue
                tail += own
                got.setdefault(base + record - 1, []).append((at + (carried if record == 0 else 0), own, bases))
            carried = tail if started else carried + tail
            base += started
        assert set(got) == set(want)
        for i, seq in want.items():
            at = 0
            for place, own, bases in got[i]:
                assert place == at and own <= piece and bases == seq[at : at + own + overlap]
                at += own
            assert at == len(seq)


def test_one_long_line_comes_in_parts(tmp_path, monkeypatch):
    """A line of bases is never held whole."""
    monkeypatch.setattr(S, "CHUNK", 100)
    path = tmp_path / "x.fa"
    path.write_text(">" + "h" * 500 + "\n" + "ACGTT" * 2000 + "\n>b\nAC>GT\n")
    with open(path, "rb") as f:
        lines = list(S.Lines(f, 0, partial=True))
    assert max(len(x) for _, x in lines if not x.startswith(b">h")) <= 200 and lines[0][1] == b">" + b"h" * 500


def test_numbers_and_kmers(spark, tmp_path):
    texts = {"a.fa": fasta(30, 9), "b.fa": fasta(3, 10), "c.fa": ">only\n" + "ACGGT" * 4000 + "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "d.fa.gz", "wt") as f:
        f.write(fasta(4, 11))
    texts["d.fa.gz"] = fasta(4, 11)
    want = {(name, i): (h, s) for name, text in texts.items() for i, (h, s) in enumerate(sequences.records(iter(text.split("\n"))))}
    got = S.records(spark, str(tmp_path), split=700).collect()
    assert {(r["file"].rpartition("/")[2], r["seq_id"]): (r["id"], r["seq"]) for r in got} == want and len(got) == len(want)
    rows = S.pieces(spark, str(tmp_path), overlap=8, piece=512, split=700)
    assert {((r["file"].rpartition("/")[2], r["seq_id"]), r["id"]) for r in rows.collect()} == {(k, h) for k, (h, s) in want.items() if s}
    code = lambda s: sum("ACGT".index(c if c in "ACGT" else "A") * 4 ** (8 - i) for i, c in enumerate(s))
    kmers = {(r["file"].rpartition("/")[2], r["seq_id"], r["pos"]): r["h"] for r in S.piece_kmers(rows, 9).collect()}
    assert kmers == {(*k, p): code(s[p : p + 9]) for k, (_, s) in want.items() for p in range(len(s) - 8)}
    assert rows.agg(F.max(F.length("bases"))).first()[0] <= 520  # the long one came in rows


def test_hash_lists(spark, tmp_path):
    r = random.Random(1)
    lists = [[r.randrange(1 << 62) for _ in range(r.choice([0, 1, 5, 40]))] for _ in range(60)]
    raw = b"".join(np.array([*x, 0xFFFFFFFFFFFFFFFF], np.uint64).tobytes() for x in lists)
    (tmp_path / "l.bin").write_bytes(raw + np.array([7], np.uint64).tobytes())  # one without an end is no list
    for size in (8, 20, 64, 1000, 1 << 20):
        with io.BytesIO(raw) as f:
            assert [x.tolist() for at in range(0, len(raw), size) for x in S._lists(f, at, min(at + size, len(raw)))] == lists
    got = S.hash_lists(spark, str(tmp_path), split=100).orderBy("seq_id").collect()
    assert [(x["seq_id"], x["hashes"]) for x in got] == list(enumerate(lists))
    assert Split("x", 0, 1).path == "x"
