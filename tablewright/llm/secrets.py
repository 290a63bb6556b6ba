"""Secret scans: patterns for what names itself a secret, and inferred grammars
for credentials that stand alone.

Labelled credentials of each format are read into a prefix tree whose states are
merged where their next-symbol frequencies are statistically compatible.  The
resulting automaton gives the likelihood of any string under the format.  A text's
candidates are its runs of credential characters, outside the patterns' matches, and
parts of them: from the run's start, after each '=' or '/', and where the beginning
that a format always has stands; up to the run's end or any character but letters and
digits.  They are scored by the best format against an automaton of ordinary text;
of those far likelier as a credential, the set without overlap that gains the most
are spans too.  A format whose credentials always begin alike is asked only where that
beginning stands.  A candidate that is likelier under the automaton of a public identifier
(labelled the same way) than under every format without such a beginning is none.

Null text is an empty text, without spans.  Every row is scanned by itself, whole, whatever
its length; an empty table gives an empty table; of candidates that gain alike the one that
begins first stays; repeated rows give repeated results; other columns are passed on.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automata import Automaton, likelihood
from .common import as_strings, free_name, quoted

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so this equals [0-9a-f]+ of 24 and more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")  # letters of other scripts bound a run like any other character
MIN_GAIN = 14.0        # log likelihood ratio, format to ordinary text
PER_FORMAT = 120       # labelled credentials drawn for each format
ALPHA = 0.05
LEAST = 16             # characters of a candidate
PLAIN_LEAST = 24       # of one under a format without a beginning of its own
FLOOR = 0.05           # pseudo-count of a symbol a state has never seen

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
# Published formats of credentials, as parts: a string stands for itself, a triple
# for between so many and so many random characters of an alphabet.
FORMATS = {
    "access_key": ["AKIA", (16, 16, _UPPER + "234567")],
    "session_key": ["ASIA", (16, 16, _UPPER + "234567")],
    "secret_key": [(32, 88, _ALNUM + "/+")],
    "personal_token": ["ghp_", (36, 80, _ALNUM)],
    "chat_token": ["xoxb-", (10, 13, _DIGIT), "-", (10, 13, _DIGIT), "-", (24, 36, _ALNUM)],
    "payment_key": ["sk_live_", (24, 99, _ALNUM)],
    "maps_key": ["AIza", (35, 35, _ALNUM + "_-")],
    "web_token": ["eyJ", (17, 90, _ALNUM + "_-"), ".eyJ", (30, 300, _ALNUM + "_-"), ".", (43, 342, _ALNUM + "_-")],
    "upper_hex": [(32, 64, _DIGIT + "ABCDEF")],
}
# Published formats of identifiers that are no secrets, written likewise.
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_HEX = _DIGIT + "abcdef"
IDENTIFIERS = {
    "uuid": [(8, 8, _HEX), "-", (4, 4, _HEX), "-", (4, 4, _HEX), "-", (4, 4, _HEX), "-", (12, 12, _HEX)],
    "upper_uuid": [(8, 8, _HEX.upper()), "-", (4, 4, _HEX.upper()), "-", (4, 4, _HEX.upper()), "-", (4, 4, _HEX.upper()), "-", (12, 12, _HEX.upper())],
    "content_id": ["Qm", (44, 44, _BASE58)],
    "content_id_32": ["bafy", (55, 55, _LOWER + "234567")],
    "integrity_256": ["sha256-", (43, 44, _ALNUM + "/+")],
    "integrity_512": ["sha512-", (86, 88, _ALNUM + "/+")],
    "public_key": ["AAAAB3NzaC1yc2EAAAADAQABAAAB", (100, 700, _ALNUM + "/+")],
    "public_key_ed": ["AAAAC3NzaC1lZDI1NTE5AAAAI", (43, 43, _ALNUM + "/+")],
}
# Words of ordinary text, from which long ordinary runs are made.
ORDINARY = """about above after again against because before between being could during every found great having
however information international into large little making might national never number often other people place
point public question rather report right school second several should since small something state still system
than that their there these thing think those through under until water where which while without world would years
aber allerdings arbeit auch beispiel besonders damit dann deutschland dieser durch eine einem entwicklung gegen
geschichte gesellschaft haben immer jahre kinder leben mehr menschen nicht oder schon sein seiner stadt
unternehmen verschiedene werden wissenschaft wurde zwischen zusammen alors annee apres aussi autre avant avec
beaucoup cette chaque chose comme dans depuis deux encore entre etait faire gouvernement grande histoire homme
jour leur maison moins monde parce pendant plus pour premier quand quelque sans toujours tout travail vous
ahora antes aunque cada casa ciudad como cuando desde despues dicho donde durante ejemplo entonces estado gobierno
hacer hasta historia hombre lugar mayor mejor menos mientras mismo mundo mundo mujer nunca nuestro otra parte pero
persona poco porque primera siempre sobre tambien tiempo trabajo index html news page images article static main
test name user file path value class type list date time version default config data table column row key http www
example com org net http""".split()


def labelled_credentials(per_format: int = PER_FORMAT, seed: int = 7, formats: dict | None = None) -> list[tuple[str, str]]:
    """(format, credential) rows in the published formats."""
    draw = random.Random(seed)
    rows = []
    for name, parts in (FORMATS if formats is None else formats).items():
        for _ in range(per_format):
            rows.append((name, "".join(p if isinstance(p, str) else "".join(draw.choices(p[2], k=draw.randint(*p[:2]))) for p in parts)))
    return rows


def ordinary_strings(n: int = 3000, seed: int = 11) -> list[str]:
    """Long runs as ordinary text has them: joined words, file and host names,
    dates, numbers, headings and rules."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = draw.choices(ORDINARY, k=draw.randint(2, 7))
        shape = draw.random()
        if shape < 0.45:
            out.append("".join(words))
        elif shape < 0.7:
            out.append(draw.choice("/_-.").join(words))
        elif shape < 0.8:
            out.append("".join(words).upper())
        elif shape < 0.88:
            out.append("".join(w.capitalize() for w in words))
        elif shape < 0.94:
            out.append(draw.choice("-=._/+" + _ALNUM) * draw.randint(16, 60))
        else:
            out.append(f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
                       + draw.choice(["T", "_", "-", "."]) + str(draw.randint(0, 10 ** 6)))
    return out


class Grammars:
    """An automaton per format and per kind of identifier, and one of ordinary text."""

    def __init__(self, labelled=None, ordinary=None, alpha: float = ALPHA, identifiers=None):
        by_format: dict[str, list[str]] = {}
        for kind, text in labelled or labelled_credentials():
            by_format.setdefault(kind, []).append(text)
        self.formats = {}
        for kind, texts in sorted(by_format.items()):
            automaton = Automaton(texts).merged(alpha).reachable()
            table, ends = automaton.table(FLOOR), automaton.end_table(FLOOR)
            # a credential may be likelier than any seen, and a little less likely
            worst = min(likelihood(table, t) / len(t) for t in texts)
            self.formats[kind] = (table, ends, worst - 0.35)
        by_kind: dict[str, list[str]] = {}
        for kind, text in labelled_credentials(formats=IDENTIFIERS) if identifiers is None else identifiers:
            by_kind.setdefault(kind, []).append(text)
        self.identifiers = []
        for kind, texts in sorted(by_kind.items()):
            automaton = Automaton(texts).merged(alpha).reachable()
            self.identifiers.append((automaton.table(FLOOR), automaton.end_table(FLOOR)))
        self.pairs = _pair_model(ordinary or ordinary_strings())
        self._prepare()

    def _prepare(self) -> None:
        self.gain = functools.lru_cache(maxsize=50_000)(self._gain)
        self._known = functools.lru_cache(maxsize=20_000)(self._parts)
        self.head = {kind: h if len(h := _head(table)) >= 3 else "" for kind, (table, _, _) in self.formats.items()}
        self.heads = tuple(sorted({h for h in self.head.values() if h}))

    def __reduce__(self):
        return _restored, (self.formats, self.identifiers, self.pairs)

    def identifier(self, part: str) -> bool:
        """Is a candidate, or what stands in it between '/' or '=', likelier an identifier
        than a credential of a format without a beginning of its own?"""
        if part.startswith(self.heads):
            return False
        plain = [(table, ends) for kind, (table, ends, _) in self.formats.items() if not self.head[kind]]
        for piece in {part, *re.split("[/=]", part)}:
            if len(piece) >= PLAIN_LEAST:
                secret = max((likelihood(table, piece, ends=ends) for table, ends in plain), default=-math.inf)
                if any(likelihood(table, piece, secret, ends) > secret for table, ends in self.identifiers):
                    return True
        return False

    def least(self, kind: str) -> int:
        return LEAST if self.head[kind] else PLAIN_LEAST

    def _gain(self, token: str) -> tuple[float, str]:
        """(best log likelihood ratio, its format), over all formats whatever the length."""
        base = self.ordinary(token)
        best = (-math.inf, "")
        for kind, (table, ends, worst) in self.formats.items():
            if token.startswith(self.head[kind]) and len(token) >= self.least(kind):
                p = likelihood(table, token, max(base, worst * len(token)), ends)
                best = max(best, (p - base, kind))
        return (-math.inf, "") if best[1] and self.identifier(token) else best

    def parts(self, run: str, min_gain: float) -> tuple[tuple[int, int], ...]:
        return (self._known if len(run) <= 256 else self._parts)(run, min_gain)

    def _parts(self, run: str, min_gain: float) -> tuple[tuple[int, int], ...]:
        """(start, end) of the candidates in ``run`` that together gain the most, without
        overlap, each ``min_gain`` at least.  All starts go through all automata at once,
        and of those that meet in a state the likelier goes on."""
        size = len(run.rstrip(".-="))
        starts = {0} | {i + 1 for i, c in enumerate(run[:size]) if c in "=/"}
        for head in self.heads:
            at = run.find(head)
            while at >= 0:
                starts.add(at)
                at = run.find(head, at + 1)
        pairs, unseen = self.pairs
        rest = [0.0] * (size + 1)  # ordinary likelihood of what is left, from each place on
        for i in range(size - 1, -1, -1):
            rest[i] = rest[i + 1] + pairs.get((run[i - 1] if i else "", run[i]), unseen)
        total, chosen = [0.0] * (size + 1), [-1] * (size + 1)  # best gain up to a place; start of the candidate that ends there
        alive: dict[tuple[str, int], tuple[float, float, int]] = {}  # (format, state): gain, likelihood, start
        for i in range(size):
            symbol, nxt = run[i], {}
            ordinary = rest[i] - rest[i + 1]
            if i in starts and size - i >= LEAST:
                for kind, head in self.head.items():
                    gain, _, start = alive.get((kind, 0), (-math.inf, 0.0, 0))
                    if run.startswith(head, i) and total[start] + gain <= total[i]:
                        alive[kind, 0] = (0.0, 0.0, i)
            total[i + 1] = total[i]
            ends_here = i + 1 == size or not run[i + 1].isalnum()
            for (kind, state), (gain, p, start) in alive.items():
                table, ends, worst = self.formats[kind]
                moves, none = table[state]
                to, step = moves.get(symbol, (state, none))
                gain, p = gain + step - ordinary, p + step
                # nothing that follows can have a likelihood over 1
                if gain - rest[i + 1] < min_gain or p < worst * (size - start):
                    continue
                if (kind, to) not in nxt or total[nxt[kind, to][2]] + nxt[kind, to][0] < total[start] + gain:
                    nxt[kind, to] = (gain, p, start)
                if ends_here and i + 1 - start >= self.least(kind) and gain + ends[to] >= min_gain and p + ends[to] >= worst * (i + 1 - start):
                    if total[start] + gain + ends[to] > total[i + 1]:
                        total[i + 1], chosen[i + 1] = total[start] + gain + ends[to], start
            alive = nxt
        found, at = [], size
        while at > 0:
            if chosen[at] >= 0:
                found.append((chosen[at], at))
                at = chosen[at]
            else:
                at -= 1
        # a part of an identifier is none either: what stands before it, back to a '=', counts too
        return tuple((a, b) for a, b in reversed(found)
                     if not self.identifier(run[a:b]) and not self.identifier(run[run.rfind("=", 0, a) + 1:b]))

    def ordinary(self, token: str) -> float:
        pairs, unseen = self.pairs
        last, total = "", 0.0
        for c in token:
            total += pairs.get((last, c), unseen)
            last = c
        return total


def _restored(formats, identifiers, pairs):
    g = Grammars.__new__(Grammars)
    g.formats, g.identifiers, g.pairs = formats, identifiers, pairs
    g._prepare()
    return g


def _head(table) -> str:
    """The symbols that strings of a format begin with, as inferred."""
    head, at = "", 0
    while len(head) < 16:
        to, symbol, p = max(((to, s, p) for s, (to, p) in table[at][0].items()), key=lambda x: x[2], default=(0, "", -math.inf))
        if p < math.log(0.9):
            break
        head, at = head + symbol, to
    return head


def _pair_model(strings) -> tuple[dict, float]:
    """Automaton of ordinary text with a state per last character; all 66
    credential characters keep some probability after any."""
    count: dict = {}
    after: dict = {}
    for s in strings:
        last = ""
        for c in s:
            count[last, c] = count.get((last, c), 0) + 1
            after[last] = after.get(last, 0) + 1
            last = c
    alphabet = _ALNUM + "+/_.=-"
    add = 0.5
    pairs = {}
    for a in ["", *alphabet]:
        n = after.get(a, 0) + add * len(alphabet)
        for c in alphabet:
            pairs[a, c] = math.log((count.get((a, c), 0) + add) / n)
    return pairs, math.log(1 / len(alphabet))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, by start then kind."""
    spans = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                spans.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
    return sorted(spans)


def format_spans(text: str, grammars: Grammars, base, min_gain: float = MIN_GAIN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of candidates likelier under a format, apart from base spans."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, _, b in [x for x in base if x[0] < m.end() and x[2] > at] + [(m.end(), 0, m.end())]:
            if a - at >= LEAST:
                out += [(at + start, 3, at + end) for start, end in grammars.parts(text[at:a], min_gain)]
            at = max(at, b)
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans, joined where they overlap, as one mark."""
    out, upto = [], 0
    joined: list[list[int]] = []
    for a, _, b in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[upto:a], mark]
        upto = b
    return "".join(out) + text[upto:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = ("base array<struct<kind: string, start: bigint, end: bigint>>, "
          "added array<struct<kind: string, start: bigint, end: bigint>>, clean string")


def scan(texts: pa.Array, grammars: Grammars, min_gain: float = MIN_GAIN) -> pa.Array:
    base, added, clean = [], [], []
    for value in as_strings(texts):
        text = value.as_py()
        found = base_spans(text)
        more = format_spans(text, grammars, found, min_gain)
        base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
        added.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in more])
        clean.append(redacted(text, found + more) if found or more else None)
    return pa.StructArray.from_arrays([pa.array(base, pa.list_(SPAN)), pa.array(added, pa.list_(SPAN)),
                                       pa.array(clean, pa.string())], names=["base", "added", "clean"])


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", grammars: Grammars | None = None,
                 min_gain: float = MIN_GAIN) -> tuple[DataFrame, str]:
    """``docs`` with a struct of base spans, spans added by the grammars, and the
    text with all spans marked out (null where there are none); and its name."""
    grammars = grammars or Grammars()

    @F.arrow_udf(SCHEMA)
    def find(texts: pa.Array) -> pa.Array:
        return scan(texts, grammars, min_gain)

    out = free_name(docs, out)
    return docs.withColumn(out, find.asNondeterministic()(quoted(text))), out


def without_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text marked out."""
    found, name = with_secrets(docs, text, **options)
    return found.select(*[F.coalesce(quoted(name).clean, quoted(c)).alias(c) if c == text else quoted(c) for c in docs.columns])


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
