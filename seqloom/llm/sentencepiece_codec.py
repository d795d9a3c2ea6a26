"""SentencePiece models on the tokenizers library.

The model file is a protobuf message; its fields are read here straight from the wire format. From them come the
normaliser (precompiled character map, extra white space, dummy prefix, the metaspace marker), the pieces with their scores
(unigram) or the merges they imply (BPE), and byte fallback. Batches are encoded by the library's own threads. Parity is
checked against the sentencepiece library on every text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, text_of

MARK = "▁"
#: Values of the model format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of one Python worker, and characters of one library call (one text at least).
THREADS, BATCH_CHARS = 2, 500_000
#: Words that a worker remembers the ids of, before it starts anew.
WORDS = 400_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, bytes or float."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError(f"not a model file: wire type {wire}")


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            m.pieces.append((x.get(1, b"").decode(), x.get(2, 0.0), x.get(3, NORMAL)))
        elif number == 2:
            x = dict(_fields(value))
            m.kind, m.byte_fallback, m.whitespace_suffix = x.get(3, UNIGRAM), bool(x.get(35, 0)), bool(x.get(24, 0))
            m.unk_surface = x[44].decode() if 44 in x else m.unk_surface
        elif number == 3:
            x = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} isn't supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; of one piece's pairs, the longest left part first."""
    usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    out = []
    for piece, score in usable.items():
        for cut in range(len(piece) - 1, 0, -1):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                out.append((-score, ids[piece], -cut, left, right))
    return [(left, right) for _, _, _, left, right in sorted(out)]


def build(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next(i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN)
    if m.kind == UNIGRAM:
        lowest = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        # pieces that must not match get a score no path takes
        scores = [(p, s if kind in (NORMAL, UNKNOWN) else 0.0 if kind == USER_DEFINED else lowest - 1e4) for p, s, kind in m.pieces]
        core = models.Unigram(scores, unk, m.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[unk][0], fuse_unk=not m.byte_fallback, byte_fallback=m.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and not m.whitespace_suffix:
        steps += [normalizers.Prepend(" " if m.escape else " ")]
    if m.escape:
        steps += [normalizers.Replace(" ", MARK)]
    out.normalizer = normalizers.Sequence(steps)
    if separable(m):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(after + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return out


def separable(m: Model) -> bool:
    """Whether no piece reaches over the start of a marked word, so that words can be encoded one by one."""
    return m.escape and not m.whitespace_suffix and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


_loaded: dict = {}
_words: dict = {}
_word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _pair(path: str):
    """(tokenizers' form, sentencepiece's own, tokenizers' form for words or None, which ids start a word, the model, its pieces' bytes) of a model file, once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        m = parse(data)
        plain = None
        if separable(m):  # encodes words that are normalised already
            from tokenizers import normalizers

            plain = build(m)
            plain.normalizer = normalizers.Sequence([])
        starts = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        _loaded[path] = build(m), sentencepiece.SentencePieceProcessor(model_proto=data), plain, starts, m, _surface(m)
    return _loaded[path]


def _parts(texts: list[str]):
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) <= BATCH_CHARS:
            chars += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text. Words seen before are remembered, at most WORDS of them; new ones go to the library in one batch."""
    tok, _, plain = _pair(path)[:3]
    if plain is None:
        return [np.asarray(x.ids, "<i4") for part in _parts(texts) for x in tok.encode_batch_fast(part, add_special_tokens=False)]
    known = _words.setdefault(path, {})
    out: list[np.ndarray] = []
    for part in _parts(texts):
        split = [_split(normalised(x, path)) if x else [] for x in part]
        if len(known) > WORDS:
            known.clear()
        if new := list({w for ws in split for w in ws}.difference(known)):
            _learn(new, known, plain, _loaded[path][3])
        out += [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<i4") for ws in split]
    return out


def _split(text: str) -> list[str]:
    """The words of a normalised text; those with one mark, at their start, without it."""
    if text[:1] == MARK and MARK * 2 not in text and text[-1] != MARK:
        return text[1:].split(MARK)
    return [w[1:] if w[0] == MARK and len(w) > 1 and w[1] != MARK else MARK + w for w in _word.findall(text)]


def _learn(new: list[str], known: dict[str, bytes], plain, starts: np.ndarray) -> None:
    """Encodes many words to a call; an id whose piece starts with the mark starts a word. What doesn't add up goes word by word."""
    easy, odd = [], []
    for w in new:
        (odd if w[:1] in (MARK, "") else easy).append(w)
    for at in range(0, len(easy), 50_000):
        part = easy[at : at + 50_000]
        ids = np.concatenate([np.asarray(x.ids, "<i4") for x in plain.encode_batch_fast([MARK + MARK.join(part[i : i + 500]) for i in range(0, len(part), 500)], add_special_tokens=False)])
        cuts = np.append(np.flatnonzero(starts[ids]), len(ids))
        if len(cuts) != len(part) + 1 or cuts[0]:
            odd += part
            continue
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
            known[w] = data[a:b]
    for at in range(0, len(odd), 5000):
        part = odd[at : at + 5000]
        for w, x in zip(part, plain.encode_batch_fast([w[1:] if w[:1] == MARK else MARK + w for w in part], add_special_tokens=False), strict=True):
            known[w] = np.asarray(x.ids, "<i4").tobytes()


def decode(ids: list[list[int]], path: str) -> list[str]:
    """Texts of id lists: the pieces' bytes in a row. Where byte pieces make no UTF-8, the library's decoder says what they become."""
    tok, _, _, _, m, surface = _pair(path)
    out: list = []
    for x in ids:
        try:
            text = b"".join([surface[i] for i in x]).decode()
            out.append(text[1:] if m.dummy_prefix and text[:1] == " " else text)
        except (UnicodeDecodeError, TypeError):
            out.append(tok.decode(x, skip_special_tokens=False))
    return out


def normalised(text: str, path: str) -> str:
    """The text as the model's normaliser gives it. One that only marks white space is two replacements."""
    tok, m = _pair(path)[0], _pair(path)[4]
    if m.charsmap or m.remove_extra or not m.escape or m.whitespace_suffix or not text:
        return tok.normalizer.normalize_str(text)
    return (MARK if m.dummy_prefix else "") + text.replace(" ", MARK)


def _surface(m: Model) -> list[bytes | None]:
    """Bytes of each piece; None for those that the library has to spell."""

    def of(piece: str, kind: int) -> bytes | None:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else None

    return [of(p, kind) for p, _, kind in m.pieces]


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids", parity: str = "parity") -> DataFrame:
    """Columns of df with the ids of each text and whether sentencepiece gives the same. Null and empty texts have no ids."""
    fields = [*df.schema.fields]

    def run(batches):
        own = _pair(path)[1]
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            got, same = [], []
            for part in _parts(texts):
                some = encode(part, path)
                got += some
                same += [a.tolist() == b for a, b in zip(some, own.encode(part, num_threads=THREADS), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [*batch.schema.names, ids, parity])

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    return df.mapInArrow(run, StructType([*fields, StructField(ids, ArrayType(IntegerType())), StructField(parity, BooleanType())]))


SUMMARY = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, decode_parity boolean, round_trip boolean, decoded_crc32 long"


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Of each document: its token count, CRC-32 of its ids, whether sentencepiece agrees on ids and on the decoded text, and whether decoding gives the normalised text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir)

    def run(batches):
        own = _pair(path)[1]
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            n, crc, same, said, back, text_crc = [], [], [], [], [], []
            for part in _parts(texts):
                ids = encode(part, path)
                crc += [zlib.crc32(x.tobytes()) for x in ids]
                ids = [x.tolist() for x in ids]
                for x, theirs, out, raw in zip(ids, own.encode(part, num_threads=THREADS), decode(ids, path), part, strict=True):
                    n.append(len(x))
                    same.append(x == theirs)
                    said.append(out == own.decode(x) if x else out == "")
                    plain = normalised(raw, path).replace(MARK, " ")
                    back.append(out == plain[1:] if plain[:1] == " " else out == plain)
                    text_crc.append(zlib.crc32(out.encode()))
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(said, pa.bool_()), pa.array(back, pa.bool_()), pa.array(text_crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32", "parity", "decode_parity", "round_trip", "decoded_crc32"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, SUMMARY)
