"""Secrets in texts: fixed forms, and what a primed compressor can't foresee."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import zstandard
from pyspark.sql import DataFrame

from duotext.llm.texts import map_texts

KINDS = ("assign", "access", "hex", "key", "webtoken", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so short ones need no match at all

# Words that make what follows sensitive, and identifiers of everyday code.
_CONTEXT = re.compile(r"secret|token|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|signature|-----BEGIN", re.I | re.A)
IDENTIFIERS = (
    "password passwd secret token apikey api_key access_key secret_key private_key client_id client_secret "
    "credential credentials authorization authenticate bearer signature username email account session cookie "
    "config configuration environment settings default example placeholder changeme undefined function return "
    "import export class public static void string integer boolean number object array length value index "
    "request response header content application json https://www.example.com/ http://localhost:8080/ "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 xxxxxxxx XXXXXXXX "
    "January February March April May June July August September October November December 2020-01-01T00:00:00Z"
)
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A value that is assigned to a sensitive name or follows ``bearer``: a candidate whatever its characters.
_VALUE = re.compile(
    r"""(?:secret|token|passw|pwd|key|credential|signature)[A-Za-z0-9_]*["']?\x20*[:=]\x20*["']?(?P<a>[A-Za-z0-9+/_=-]{16,})|bearer\x20+(?P<b>[A-Za-z0-9+/_=-]{16,})""", re.I | re.A)
#: A candidate lies within so many characters of a sensitive word or of a span found; so much text around it primes the compressor.
_REACH, _AROUND = 64, 256
#: The body of a private key: up to its last line or, where that is missing, while lines (or escaped ones) are base64.
_KEY = re.compile(
    r"-----BEGIN (?P<name>[A-Z0-9 ]*PRIVATE KEY[A-Z ]*)-----"
    r"(?:(?P<closed>(?:(?!-----BEGIN )[\s\S])*?)-----END (?P=name)-----"
    r"|(?P<open>(?:(?:\s|\\[nrt])*[A-Za-z0-9+/=]{16,}(?![^\s\\\"'<]))+(?:(?:\s|\\[nrt])*[A-Za-z0-9+/]+={1,2})?))", re.A)
#: A JSON Web Token with all its parts, the last of which may be empty.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*){2,4}", re.A)


class _Cover:
    """Spans as disjoint sorted intervals, so that a text's length enters once, not once per span."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for s, e, _ in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def inside(self, start: int, end: int) -> list[tuple[int, int]]:
        """The intervals that share a character with start to end."""
        low, high = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return list(zip(self.starts[low:high], self.ends[low:high], strict=True))

    def meets(self, start: int, end: int) -> bool:
        return bisect_right(self.ends, start) < bisect_left(self.starts, end)


class Scanner:
    """``novelty``: least marginal compressed bytes per byte of a candidate that is reported."""

    def __init__(self, novelty: float = 0.7):
        self.novelty = novelty
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def marginal(self, around: str, candidate: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, per byte."""
        base = around.encode()
        return (len(self.compress(base + candidate.encode())) - len(self.compress(base))) / len(candidate)

    def known(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """What of private keys (``key``) and web tokens (``webtoken``) lies outside ``taken``."""
        whole = [(*m.span(m.lastgroup), "key") for m in _KEY.finditer(text) if _WORD.search(m[m.lastgroup])] if "PRIVATE KEY" in text else []
        known = [p for s, e, kind in whole for p in self._outside(text, s, e, kind, _Cover(taken))]
        tokens = [(*m.span(), "webtoken") for m in _JWT.finditer(text)] if "eyJ" in text else []
        cover = _Cover(taken + known) if tokens else None
        return known + [p for s, e, kind in tokens for p in self._outside(text, s, e, kind, cover)]

    @staticmethod
    def _outside(text: str, at: int, end: int, kind: str, cover: _Cover) -> list[tuple[int, int, str]]:
        out = []
        for s, e in [*cover.inside(at, end), (end, end)]:
            if at < s and not text[at:s].isspace():
                out.append((at, s, kind))
            at = max(at, e)
        return out

    def novel(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Novel strings within reach, on either side, of a sensitive word, a span of ``taken`` or another novel string."""
        hints = [m.span() for m in _CONTEXT.finditer(text)]
        near = sorted(hints + [(s, e) for s, e, _ in taken])
        if not near:
            return []
        words = {m.span() for m in _WORD.finditer(text)}
        words |= {m.span() for _, end in hints if (m := _WORD.match(text, end))}  # behind a sensitive word that it is joined to
        values = {m.span(m.lastgroup) for m in _VALUE.finditer(text)}
        cover = _Cover(taken)
        spans = sorted(w for w in words | values if (w in values or self._mixed(text[slice(*w)])) and not cover.meets(*w))
        waiting, at, edge = [], 0, -_REACH - 1
        for i, (start, end) in enumerate(spans):
            while at < len(near) and near[at][0] < start:
                edge, at = max(edge, near[at][1]), at + 1
            if start - edge <= _REACH or at < len(near) and near[at][0] - end <= _REACH:
                waiting.append(i)
        seen, found = set(waiting), []
        while waiting:
            i = waiting.pop()
            start, end = spans[i]
            around = text[max(0, start - _AROUND):start] + text[end:end + _AROUND]
            if self.marginal(around, text[start:end]) < self.novelty:
                continue
            found.append((start, end, "novel"))
            for side in (range(i + 1, len(spans)), range(i - 1, -1, -1)):
                for k in side:
                    if max(spans[k][0] - end, start - spans[k][1]) > _REACH:
                        break
                    if k not in seen:
                        seen.add(k)
                        waiting.append(k)
        return found

    @staticmethod
    def _mixed(value: str) -> bool:
        kinds = sum((any(map(str.isdigit, value)), any(map(str.isupper, value)), any(map(str.islower, value))))
        return kinds >= 2 and not value.istitle()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start and then kind; the base kinds are leftmost non-overlapping per kind."""
        base = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        base += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        base += [(*m.span(), "hex") for m in _HEX.finditer(text)]
        fixed = base + self.known(text, base)
        return sorted(fixed + self.novel(text, fixed), key=lambda s: (s[0], KINDS.index(s[2])))


def _shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, novelty: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_assign, n_access, n_hex BIGINT, base_sha256 and spans STRING.

    spans lists kind:start:end of all spans; base_sha256 is the SHA-256 of the list of
    those of the three fixed forms.  ``key`` spans are the bodies of private keys, ``webtoken`` ones web tokens, by their
    form.  ``novel`` spans are strings within 64 characters of a sensitive word or of another span, on either side,
    or assigned to a sensitive name, whose marginal zstandard size, primed with the text around and with everyday
    identifiers, stays near their length.  None of them overlaps a fixed form.  NULL and empty texts have no spans; a
    long text takes time in proportion to its length.
    """

    def make():
        scanner = Scanner(novelty)

        def work(texts: list[bytes]):
            spans = [scanner.spans(t.decode()) for t in texts]
            base = [[s for s in x if s[2] in KINDS[:3]] for x in spans]
            counts = [[sum(s[2] == kind for s in x) for x in base] for kind in KINDS[:3]]
            return [*counts, [hashlib.sha256(_shown(x).encode()).hexdigest() for x in base], list(map(_shown, spans))]

        return work

    return map_texts(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", keep)


def mask(docs: DataFrame, novelty: float = 0.7, keep: tuple[str, ...] = ("doc_id",), mark: str = "[SECRET]") -> DataFrame:
    """``keep`` with ``text`` where each union of overlapping spans is replaced by ``mark``; NULL becomes empty."""

    def make():
        scanner = Scanner(novelty)

        def clean(data: bytes) -> str:
            text = data.decode()
            out, at = [], 0
            for start, end, _ in scanner.spans(text):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:]

        return lambda texts: [list(map(clean, texts))]

    return map_texts(docs, make, "text string", keep)
