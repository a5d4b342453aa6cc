"""Secrets by pattern and by zstandard novelty.

Three fixed patterns give the base spans.  Beyond them, a candidate is a long run of token
characters with letters and digits near a sensitive word, before or after it.  Candidates with
nothing but blanks and punctuation between them are a run, such as the lines of a wrapped key, and
what is sensitive for one of a run is so for all.  The novelty of a candidate is what it adds to the
compressed size of its surroundings: bytes of (before + candidate + after) less bytes of
(before + after), with a compressor primed by an identifier dictionary and the rest of the
neighbourhood.  Names, paths and prose repeat what is around them and add little; a key cannot be
compressed and adds most of its entropy.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# fixed values: the patterns of the base kinds, in the order of the report
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so as good as all runs of which the short ones are dropped
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitive surroundings of a candidate, and how far before or after it they may stand.
SENSITIVE = re.compile(r"passw|passwd|pwd|secret|token|api.?key|credential|bearer|private|auth|signature|session|login", re.I)
REACH = 80
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Between the candidates of a run; \\n may be spelt out.
GAP = re.compile(r"(?:[\W_]|\\[rnt])*")
#: The end of a wrapped key, too short for a candidate: a line of its own after the last one.
TAIL = re.compile(r"""["',+\\\x20\t]*(?:\r?\n|\\r\\n|\\n)(?:[\x20\t"'>|#]|\+(?=[\x20"']))*([A-Za-z0-9+/_-]{1,15}={0,2})(?=["',;+\x20\t]*(?:[\r\n\\]|\Z))""")
#: A PEM block up to its end, with whatever headers.
ARMOR = re.compile(r"-----BEGIN ([^\n-]*)-----")
ARMOR_END = re.compile("-----END")
#: Characters on either side that prime the compressor.
AROUND = 2_000
#: Least share of a candidate's length that it adds to the compressed size, and least bytes.  Of
#: a small alphabet it needs no more than its characters' entropy and the least cost of their code.
NOVELTY, LEAST_BYTES, CODE = 0.75, 10, 6
#: Sizes of the alphabets keys are written in; from LONG characters on, those that occur are counted.
ALPHABETS = tuple(
    (re.compile(p), n)
    for p, n in ((r"[0-9]+", 10), (r"[0-9A-F]+|[0-9a-f]+", 16), (r"(?:[A-Z2-7]+|[a-z2-7]+)=*", 32), (r"[0-9A-Z]+|[0-9a-z]+", 36), (r"[0-9A-Za-z]+", 62))
)
LONG = 64
#: What code and configuration repeat anyway.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 true false null none return import class function "
    "public private static const string integer boolean password secret token api key access client server user name "
    "config default value http https www com org net example localhost index version content type application json "
    "authorization bearer session cookie header request response database connection production development test "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 00000000-0000-0000-0000-000000000000"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost non-overlapping per kind, in order."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novelty(text: str, start: int, end: int) -> int:
    """Bytes that text[start:end] adds to its compressed surroundings, in which its copies don't count."""
    import zstandard

    body = text[start:end]
    before = text[max(0, start - AROUND) : start].replace(body, "").encode()
    after = text[end : end + AROUND].replace(body, "").encode()
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + after + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)
    near = before[-64:]
    return len(compressor.compress(near + body.encode())) - len(compressor.compress(near))


def enough(body: str) -> float:
    """Bytes a candidate must add: what random characters of its alphabet would, at the least."""
    letters = len(set(body)) if len(body) >= LONG else next((n for p, n in ALPHABETS if p.fullmatch(body)), 64)
    return max(LEAST_BYTES, min(NOVELTY * len(body), len(body) * math.log2(letters) / 8 + CODE))


def _runs(text: str) -> list[list[re.Match]]:
    """Candidates in runs; one without letters or without digits counts as a further line of a run only."""
    out: list[list[re.Match]] = []
    last = None
    for m in CANDIDATE.finditer(text):
        mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        follows = last is not None and GAP.fullmatch(text, last.end(), m.start())
        if follows and (mixed or re.search(r"[\r\n\\]", text[last.end() : m.start()])):
            out[-1].append(m)
        elif mixed:
            out.append([m])
        else:
            continue
        last = m
    return out


class Spans:
    """Spans of one kind, in order and without overlap: is a range touched by one of them?"""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def _armored(text: str) -> Spans:
    """The bodies of sensitive PEM blocks, merged where they overlap."""
    begun = [m.end() for m in ARMOR.finditer(text) if SENSITIVE.search(m[1])]
    ends = [m.start() for m in ARMOR_END.finditer(text)] if begun else []
    out: list[tuple[int, int]] = []
    for start in begun:
        at = bisect_right(ends, start - 1)
        if at == len(ends):
            break  # none of these ends
        if out and start < out[-1][1]:
            continue  # up to the same end
        out.append((start, ends[at]))
    return Spans(out)


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, bytes) of incompressible candidates in sensitive surroundings, beside the taken spans."""
    if not SENSITIVE.search(text):
        return []
    blocks = _armored(text)
    by_kind = [Spans([(a, b) for a, k, b in taken if k == kind]) for kind in range(3)]

    def hit(start: int, end: int) -> bool:
        return any(spans.meets(start, end) for spans in by_kind)

    def sensitive(m: re.Match) -> bool:
        near = SENSITIVE.search(text, max(0, m.start() - REACH), m.start()) or SENSITIVE.search(text, m.end(), m.end() + REACH)
        return bool(near) or by_kind[0].meets(m.start(), m.end()) or blocks.meets(m.start(), m.start() + 1)

    out = []
    for run in _runs(text):
        if not any(map(sensitive, run)):
            continue
        secret = 0
        for m in run:
            found = hit(m.start(), m.end())
            if not found:
                size = novelty(text, m.start(), m.end())
                found = size >= enough(m[0])
                if found:
                    out.append((m.start(), 3, m.end(), size))
            secret = secret + 1 if found else 0
        tail = TAIL.match(text, run[-1].end()) if secret else None
        if tail and re.search("[A-Za-z0-9]", tail[1]) and (secret > 1 or re.search("[0-9+/=]", tail[1])) and not hit(*tail.span(1)):
            out.append((tail.start(1), 3, tail.end(1), novelty(text, *tail.span(1))))
    return out


def spans_of(text: str | None) -> list[tuple[int, int, int, int | None]]:
    """(start, kind number, end, novelty or None) of all spans of a text, by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted([*[(*s, None) for s in base], *novel_spans(text, base)], key=lambda s: s[:3])


SPAN = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "bytes")]])


def scan(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """docs with an array of spans (kind, start, end, bytes): code points, end exclusive, by start and kind.

    bytes is the novelty of a `novel` span, null for base kinds.  Null and empty texts have no spans;
    all rows, nulls in other columns and repeated rows stay as they are.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(SPAN))])
    place = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64())]))
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b, "bytes": n} for a, k, b, n in spans_of(t.as_py())] for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def without(text: str, mark: str) -> str:
    """The text with every span replaced by the mark, spans that overlap by one."""
    out, at, reached = [], 0, 0
    for start, _, end, _ in spans_of(text):
        if start >= reached:
            out += [text[at:start], mark]
        at = reached = max(reached, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", size: str = "n_chars") -> DataFrame:
    """docs with every span replaced by the mark and, where that happened, the size column (if any) set anew.

    All rows and other columns stay as they are, null texts too.
    """
    place = docs.columns.index(text)
    counted = docs.columns.index(size) if size in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = list(batch.columns)
            before = columns[place].to_pylist()
            after = [t and without(t, mark) for t in before]
            columns[place] = pa.array(after, columns[place].type)
            if counted is not None:
                kept = columns[counted].to_pylist()
                sizes = [n if a == b else len(a) for n, a, b in zip(kept, after, before)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans, kinds: tuple[str, ...]):
    """Spans of some kinds as kind:start:end, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
