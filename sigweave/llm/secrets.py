"""Secrets in texts: rules, and random strings that a vocabulary of ordinary text can't compress.

The rules' spans always stay. Beside them, runs of the letters that keys are written in
are counted in tokens of a public vocabulary. Words, names and numbers that people write
are made of long tokens; random strings fall into short ones, so few characters a token
give them away. Known digests and identifiers are left out first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches

KINDS = ("assign", "access", "hex", "random")
#: The rules. Where a contract's length is checked after the match, the pattern asks for it at once: runs are taken whole, so no other match arises.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGNED = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

#: Runs that may be keys, not beside a letter or digit of any script; padding may follow.
CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![^\W_])")
#: Characters a token up to which a candidate counts as random. Random strings have 1.2 to 2.0; invented words of letters alone come down to 1.8.
RATIOS = {"mixed": 1.9, "letters": 1.5}
#: Candidates are counted in parts of so many characters, so that one of any length takes time in proportion to it.
PART = 256
#: Hexadecimal digits of known digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEXADECIMAL = re.compile("[0-9A-Fa-f]+")
#: A digest that names its algorithm, as in sha384-... of web pages or sha256: of images.
NAMED_DIGEST = re.compile(r"(?ai:(?:md5|sha-?[0-9]{1,3}|blake2[bs]|blake3)[:=_-])")
NAME_BEFORE = re.compile(r"(?ai:(?:md5|sha-?[0-9]{1,3}|blake2[bs]|blake3)[:=_-])\Z")
#: Pieces of identifiers, paths and dates: letters in one case or with a capital first, a few digits after them or alone.
PIECE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,8}[a-z]?")
#: Letters as a word has them; other runs of letters mix cases.
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

_encodings: dict[str, object] = {}


def _encoding(path: str):  # noqa: ANN202
    """The tokenizer of a tiktoken rank file, read once a worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known(run: str) -> bool:
    """Whether a run is a digest of a known length, a UUID, a digest that names its algorithm, or an identifier, path, date or number."""
    bare = run.rstrip("=")
    if UUID.fullmatch(bare) or NAMED_DIGEST.match(run) or bare.isdigit():
        return True
    if len(bare) in DIGESTS and HEXADECIMAL.fullmatch(bare):
        return True
    pieces = [p for p in re.split("[+/_-]+", bare) if p]
    return len(pieces) != 1 and all(PIECE.fullmatch(p) for p in pieces)


def ratio(run: str, encoding) -> float:  # noqa: ANN001
    """Characters a token, over the whole run."""
    return len(run) / sum(len(encoding.encode_ordinary(run[i : i + PART])) for i in range(0, len(run), PART))


def is_random(run: str, encoding) -> bool:  # noqa: ANN001
    """Whether a run that isn't known has as few characters a token as random strings of its sort have."""
    return ratio(run, encoding) <= RATIOS["letters" if WORD.fullmatch(run) else "mixed"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the rules find, sorted."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGNED]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(start, end, kind) of random strings that touch no span of `base`, sorted; those that a single dot joins (as in signed web tokens) are one."""
    out: list[tuple[int, int, int]] = []
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        if at < len(base) and base[at][0] < end:
            continue
        if known(m.group()) or NAME_BEFORE.search(text, max(0, start - 12), start) or not is_random(m.group(), encoding):
            continue
        if out and out[-1][1] + 1 == start and text[start - 1] == ".":
            out[-1] = (out[-1][0], end, 3)
        else:
            out.append((start, end, 3))
    return out


def found(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, base and added: arrays of (start, end, kind) in code points, end exclusive, by start and then kind (a place in KINDS).

    `path` names a tiktoken rank file, which every worker must be able to read. A row
    each, whatever the id; a null text counts as empty; further columns are left out.
    """
    bounded_batches(docs.sparkSession)
    kind = "array<struct<start:int,end:int,kind:int>>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
        for batch in batches:
            base, added = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base.append(base_spans(text))
                added.append(added_spans(text, base[-1], encoding))
            as_rows = [[[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in side] for side in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows, spans) for rows in as_rows)], ["doc_id", "base", "added"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {id_type}, base {kind}, added {kind}")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(by_place, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, path: str) -> DataFrame:
    """The documents with all their columns, each secret in `text` replaced by `[SECRET]`; a null text stays null.

    Spans that overlap are one secret. Texts stay in their rows, so ids may repeat or be null.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    out, done = [], 0
                    for start, end, _ in sorted(base + added_spans(text, base, encoding)):
                        if start >= done:
                            out += [text[done:start], "[SECRET]"]
                        done = max(done, end)
                    text = "".join([*out, text[done:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(made, docs.schema)
