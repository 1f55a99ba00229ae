"""Secret scan: all rules in one pass of a combined automaton over the bytes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm.automaton import Automaton, Spans, compile_rules
from antecede.llm.textbytes import slices


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans, leftmost, longest and not overlapping; those that ``full`` matches count.

    ``probe`` is what the automaton looks for: every span that counts has to hold a match of it. It leaves
    out lengths where they would multiply the states of the combined automaton.
    """

    kind: str
    pattern: str
    full: str
    probe: str


_KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _KEYWORD + "[A-Za-z0-9+/_.=-]+", _KEYWORD + "[A-Za-z0-9+/_.=-]{8,}", _KEYWORD + "[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32,}", "[0-9a-f]{32}"),
)
#: Rules beyond the base: private key headers and tokens with a fixed prefix.
MORE = (
    Rule("pem", "-----BEGIN (?:[A-Z ]+)?PRIVATE KEY-----", "-----BEGIN (?:[A-Z ]+)?PRIVATE KEY-----", "-----BEGIN [A-Z]"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
)


def hit_pieces(auto: Automaton, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, rules) of the pieces between breaks in which some rule's match ends; one pass over the bytes.

    Pieces begin in the start state, so all of them advance together, a byte at a time, longest first. Where only a few long ones are
    left, each goes on alone from its state, as a step of an array costs as much as some hundred plain ones.
    """
    cut = np.zeros(len(buf) + 1, bool)
    cut[:-1] = auto.breaks[buf]
    inside = ~cut
    inside[-1] = False
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    size = ends - begins
    long = size >= MIN_PIECE
    begins, ends, size = begins[long], ends[long], size[long]
    order = np.argsort(-size, kind="stable")
    begins, ends, size = begins[order], ends[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # pieces longer than i bytes
    codes = auto.classes[buf]
    flat, width = auto.step.reshape(-1), auto.step.shape[1]
    state = np.zeros(len(size), np.int32)
    found = np.zeros(len(size), np.int64)
    together = int(np.searchsorted(-live, -FEW, "right"))
    for i, n in enumerate(live[:together]):
        now = flat[state[:n] * width + codes[begins[:n] + i]]
        state[:n] = now
        found[:n] |= auto.accepts[now]
    if together < len(live):
        step, accepts = auto.step[:, auto.classes].tolist(), auto.accepts.tolist()
        for k in range(int(live[together])):
            at, hit = int(state[k]), int(found[k])
            for byte in buf[begins[k] + together:ends[k]].tobytes():
                at = step[at][byte]
                hit |= accepts[at]
            found[k] = hit
    for k in np.flatnonzero(found):
        yield int(begins[k]), int(ends[k]), int(found[k])


#: No rule matches fewer bytes.
MIN_PIECE = 8
#: With fewer pieces than this, each is stepped alone.
FEW = 256


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) per row; code points, end exclusive, by start, then rule order.

    NULL and empty texts have no spans. Repeated rows get equal answers, NULL ids are carried along, an empty table gives an
    empty one, other columns are ignored. One pass of the combined automaton says which pieces hold a match of which rules; the
    transition arrays of the rule (:class:`Spans`) then give the spans of such a piece. No match crosses a piece, so that is the
    answer over the whole text. Time grows with the bytes of a text, however long it is and whether or not anything breaks it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(compile_rules([r.probe for r in rules], [r.pattern for r in rules])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(*shared.value)
        exact = [Spans(r.pattern, r.full) for r in rules]
        for rows, buf, offsets in slices(batches):
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(rows.num_rows)]
            for begin, end, hit in hit_pieces(auto, buf, offsets):
                piece = buf[begin:end].tobytes()
                row = int(np.searchsorted(offsets, begin, "right")) - 1
                for k, rule in enumerate(exact):
                    if hit >> k & 1:
                        spans[row] += [(begin + a, k, begin + b) for a, b in rule.find(piece)]
            if any(spans):
                point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            out = [[{"kind": rules[k].kind, "start": int(point[a] - point[offsets[i]]), "end": int(point[b] - point[offsets[i]])}
                    for a, k, b in sorted(own)] for i, own in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, SPANS)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def joined(spans, kinds: list[str] | None = None):
    """kind:start:end of the spans (of these kinds), comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
