"""Secret scans: fixed patterns, and formats of credentials learned by grammar inference.

The matches of the fixed patterns are labelled credentials. From a bounded sample of them (`SAMPLE` of each
kind, chosen by hash) one probabilistic automaton per kind is inferred by merging compatible states of
their prefix tree, and two of ordinary tokens, those that no fixed pattern touches. Those are sampled twice, among distinct
tokens (rare formats) and among places (common words). Every token of at least `LEAST` characters in every text,
letter-only ones included, is then scored by how much likelier a credential's format makes it than ordinary text does; those above
`MARGIN` per character become spans of kind `format`. Spans of the fixed patterns always stay.

Null and empty texts have no spans; repeated rows are treated alike. `find_secrets` returns the named columns
and `secrets`; `redact` replaces the spans and keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.llm.automata import Automaton, infer
from lodebook.session import materialize, ship_package

BASE_KINDS = ("assign", "access", "hex")
ORDINARY = ("distinct", "place")
SAMPLE = 1000
LEAST = 6  # characters of the shortest labelled credential
MARGIN = 0.35
MARK = "[SECRET]"
REMEMBERED = 50_000

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_BYTE = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
TOKEN_BYTE = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_.=-") for b in range(256)])

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of kind, end, the credential) of the fixed patterns in one text, in order."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans


def _long_runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = arrays.runs(mask, offsets)
    good = ends - starts >= least
    return starts[good], ends[good]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Starts and ends of all tokens of at least `LEAST` characters, and their values, distinct ones once."""
    starts, ends = _long_runs(TOKEN_BYTE[data], offsets, LEAST)
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    held = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    values = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    return starts, ends, values.dictionary_encode()


def _occurrence_keys(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each token, its place and its text's length: copies of a text have equal ones."""
    rows = arrays.rows_of(starts, offsets)
    places, lengths = (starts - offsets[rows]).astype(np.uint64), np.diff(offsets)[rows].astype(np.uint64)
    h = arrays.segment_hashes(data, starts, ends) + places * np.uint64(0x9E3779B97F4A7C15) + lengths * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


Chooser = Callable[[list[str]], list[bool]]


def scan(texts: pa.Array, choose: Chooser, limit: Callable[[], int] | None = None) -> Iterator[tuple[int, list, list]]:
    """(row, base spans, other tokens with their keys) of the texts that have any.

    `choose` says which of distinct tokens are given; with `limit`, tokens whose occurrence has a key up to it are too.
    """
    for first, _, data, offsets in arrays.blocks(texts):
        hex_starts, hex_ends = _long_runs(HEX_BYTE[data], offsets, 24)
        starts, ends, values = _tokens(data, offsets)
        if len(starts):
            good, keys = np.array(choose(values.dictionary.to_pylist()), bool)[values.indices.to_numpy()], np.zeros(len(starts), np.uint64)
            if limit is not None:
                keys = _occurrence_keys(data, offsets, starts, ends)
                good |= keys <= np.uint64(limit())
            starts, ends, keys = starts[good], ends[good], keys[good]
        else:
            keys = np.zeros(0, np.uint64)
        raw = data.tobytes()
        hints = [m.start() for m in ASSIGN_HINT.finditer(raw)]
        at = raw.find(b"AKIA")
        while at >= 0:
            hints.append(at)
            at = raw.find(b"AKIA", at + 4)
        hex_rows, token_rows = arrays.rows_of(hex_starts, offsets), arrays.rows_of(starts, offsets)
        hint_rows = np.unique(arrays.rows_of(np.array(hints, np.int64), offsets))
        hinted = set(hint_rows.tolist())
        for row in np.unique(np.concatenate([hex_rows, token_rows, hint_rows])).tolist():
            own = raw[offsets[row]:offsets[row + 1]]
            text = own.decode()
            plain = len(text) == len(own)
            here = int(offsets[row])
            before = None if plain else np.concatenate([[0], np.cumsum((data[here:offsets[row + 1]] & 0xC0) != 0x80)])

            def place(byte: int, before: np.ndarray | None = before, here: int = here) -> int:
                return byte - here if before is None else int(before[byte - here])

            spans = base_spans(text) if row in hinted else []
            a, b = np.searchsorted(hex_rows, [row, row + 1])
            for s, e in zip(hex_starts[a:b].tolist(), hex_ends[a:b].tolist(), strict=True):
                start = place(s)
                spans.append((start, 2, start + e - s, raw[s:e].decode()))
            spans.sort()
            tokens = []
            a, b = np.searchsorted(token_rows, [row, row + 1])
            for s, e, key in zip(starts[a:b].tolist(), ends[a:b].tolist(), keys[a:b].tolist(), strict=True):
                start = place(s)
                tokens.append((start, start + e - s, raw[s:e].decode(), key))
            if spans or tokens:
                yield first + row, spans, tokens


class Formats:
    """Automata of credentials by kind, and of ordinary tokens: of distinct ones and of places in texts."""

    def __init__(self, credentials: dict[str, list[str]], *ordinary: list[str]):
        self.kinds: dict[str, Automaton] = {k: infer(v) for k, v in credentials.items() if v}
        self.ordinary = [infer(v) for v in ordinary if v]

    def score(self, token: str) -> float:
        """Log likelihood per character of the best credential format over that of ordinary tokens."""
        if not self.kinds:
            return float("-inf")
        usual = [a.likelihood(token) for a in self.ordinary]
        return max(a.likelihood(token) for a in self.kinds.values()) - max([-2.5, *usual])

    def chooser(self, margin: float) -> Callable[[list[str]], list[bool]]:
        """Which tokens score above the margin; the answers of up to `REMEMBERED` tokens are kept."""
        known: dict[str, bool] = {}

        def choose(tokens: list[str]) -> list[bool]:
            if len(known) > REMEMBERED:
                known.clear()
            return [known[t] if t in known else known.setdefault(t, self.score(t) > margin) for t in tokens]

        return choose


def learn_formats(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> Formats:
    """Infer the automata from the matches of the fixed patterns in docs.

    At most `sample` distinct values of each kind and as many places of ordinary tokens reach the driver,
    those with the smallest hashes among all texts.
    """
    ship_package(docs.sparkSession)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each task gives its own smallest hashes; the smallest of all are among them.
        kept: dict[str, dict[str, str]] = {k: {} for k in (*BASE_KINDS, *ORDINARY)}

        most = dict.fromkeys(ORDINARY, "g")  # after every digest

        def trim(kind: str, size: int) -> None:
            if len(kept[kind]) > size:
                kept[kind] = dict(sorted(kept[kind].items())[:sample])
                most[kind] = max(kept[kind])

        def small(tokens: list[str]) -> list[bool]:
            return [hashlib.md5(t.encode()).hexdigest() <= most["distinct"] for t in tokens]

        def limit() -> int:
            return int(most["place"], 16) if most["place"] != "g" else (1 << 64) - 1

        for batch in batches:
            for _, spans, tokens in scan(arrays.column(batch, "text"), small, limit):
                for _, k, _, v in spans:
                    kept[BASE_KINDS[k]][hashlib.md5(v.encode()).hexdigest()] = v
                for s, e, v, key in tokens:
                    if not any(s < end and start < e for start, _, end, _ in spans):
                        kept["distinct"][hashlib.md5(v.encode()).hexdigest()] = v
                        kept["place"][f"{key:016x}"] = v
                for kind in kept:
                    trim(kind, 8 * sample)
        for kind in kept:
            trim(kind, sample)
            rows = list(kept[kind].items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.string()), pa.array([h for h, _ in rows], pa.string()),
                 pa.array([v for _, v in rows], pa.string())], ["kind", "digest", "value"])

    found = materialize(docs.select(F.col(text_column).cast("string").alias("text"))
                        .mapInArrow(values, "kind string, digest string, value string"), "secret-values")
    taken = {kind: [r["value"] for r in found.where(F.col("kind") == kind).select("digest", "value").distinct()
                    .orderBy("digest").limit(sample).collect()] for kind in (*BASE_KINDS, *ORDINARY)}
    return Formats({k: taken[k] for k in BASE_KINDS}, *[taken[k] for k in ORDINARY])


def row_spans(spans: list, tokens: list, formats: Formats, margin: float) -> list[dict]:
    """All spans of a text: the fixed ones, and learned ones that touch none of them."""
    out = [{"kind": BASE_KINDS[k], "start": s, "end": e, "score": 1.0} for s, k, e, _ in spans]
    for s, e, value, _ in tokens:
        if not any(s < b["end"] and b["start"] < e for b in out):
            score = formats.score(value)
            if score > margin:
                out.append({"kind": "format", "start": s, "end": e, "score": score})
    order = {k: i for i, k in enumerate((*BASE_KINDS, "format"))}
    return sorted(out, key=lambda x: (x["start"], order[x["kind"]]))


def find_secrets(docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text",
                 margin: float = MARGIN) -> DataFrame:
    """Id and `secrets`, an array of (kind, start, end, score) by start, of every row of docs; no shuffle."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = formats.chooser(margin)
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for row, spans, tokens in scan(arrays.column(batch, "text"), choose):
                found[row] = row_spans(spans, tokens, formats, margin)
            yield pa.RecordBatch.from_arrays([arrays.column(batch, "id"), pa.array(found, SPAN_TYPE)], [id_column, "secrets"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, secrets {SPANS}")


def redact(docs: DataFrame, formats: Formats, text_column: str = "text", mark: str = MARK,
           margin: float = MARGIN) -> DataFrame:
    """docs with every secret replaced by `mark`; texts without one are unchanged, null stays null."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = formats.chooser(margin)
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = batch.column(at)
            changed: dict[int, str] = {}
            for row, spans, tokens in scan(texts, choose):
                text, end, pieces = texts[row].as_py(), 0, []
                for s in row_spans(spans, tokens, formats, margin):
                    if s["start"] >= end:
                        pieces += [text[end:s["start"]], mark]
                    end = max(end, s["end"])
                if pieces:
                    changed[row] = "".join([*pieces, text[end:]])
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[r] for r in sorted(changed)], texts.type))
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each row of docs (doc_id, text)."""
    found = find_secrets(docs, learn_formats(docs))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"))
