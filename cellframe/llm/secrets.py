"""Secret scans: fixed patterns, and values in a credential's place that are hard to guess.

Base kinds are leftmost non-overlapping matches of fixed patterns: ``assign`` (a credential's
name, a sign and a value of eight characters or more; the span is the whole match), ``access``
(access key ids) and ``hex`` (long hexadecimal runs). The method adds the kind ``guess``: a
value that stands in a credential's place but that no base span touches is cut into words,
dates, repeats, keyboard walks and brute-force spans so that the number of guesses is least;
from ``STRONG`` on (as a power of ten) it is a secret, below it is a word or a stand-in. Values
of letters alone are judged like all others. After "is" or "was", where ordinary sentences go
on, one whose letters follow each other as in words is also a guess from a large word list
(``LISTED``), as is one of ``PROSE`` after any sign; so a made-up word that can be spoken is not found there.

Spans count code points, ends are exclusive. A null or empty text has no span. Every text is
scanned whole in the task that reads it; there is no shuffle. Columns pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: power of ten of the guesses from which a value in a credential's place is a secret
STRONG = 10.0

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: looked for before a pattern is tried: each name in ASSIGN, and each in PLACE, holds one of these
NAMES = ("passw", "secret", "token", "apikey", "api_key")
PLACE_NAMES = ("pass", "pwd", "credential", "secret", "token", "key")
PLACE = re.compile(r"""(?:passwords?|passwd|pwd|passphrase|passcode|credentials?|secret(?:[_-]?key)?|(?:auth|access|bearer)?[_-]?token|(?:api|access|private|auth|client)[_-]?key)["']?(?:[ \t]*(?:[:=]|=>|->)|[ \t]+(?P<said>is|was)[ \t])[ \t]*["'`]?(?P<value>[^\s"'`<>,;]{6,})""", re.IGNORECASE | re.ASCII)

# Words of frequent passwords, most frequent first.
WORDS = """password qwerty dragon monkey letmein football iloveyou baseball welcome admin master login sunshine princess shadow
superman michael jordan hunter ranger buster soccer harley batman andrew tigger charlie robert thomas hockey george jessica
pepper daniel access starwars klaster jennifer summer ashley amanda joshua maggie freedom ginger hello secret test user guest
root default changeme example sample token value none null true false here your enter insert redacted hidden placeholder
string key pass love money computer internet server data system backup private public company office mustang cheese
whatever orange banana purple flower winter spring autumn january february march april june july august september october
november december monday friday sunday""".split()
# Words of sentences about credentials; with WORDS they show which letters follow each other.
PROSE = """required incorrect invalid expired missing wrong correct valid empty unknown optional mandatory necessary important confidential
sensitive protected encrypted decrypted hashed stored saved shared changed created updated deleted removed replaced rejected accepted accidentally
generated issued assigned requested returned received verified validated checked compared compromised exposed leaked stolen disclosed revealed
published printed displayed visible available unavailable accessible configured provided supplied entered forgotten remembered reused rotated
revoked refreshed renewed reset restored recovered registered authenticated authentication authorization authorized unauthorized
information documentation configuration application environment administrator organization description identification registration
something nothing anything everything someone somewhere sometimes always never already usually probably certainly actually
automatically immediately temporarily permanently successfully currently previously obviously definitely absolutely basically
considered believed supposed intended expected allowed forbidden denied granted blocked locked disabled enabled active inactive
different identical similar equal longer shorter stronger weaker simple complex complicated difficult impossible possible sufficient
insufficient following followed included excluded contained embedded attached located hardcoded written readable recorded
working broken failing passing testing missing pending waiting sending getting setting using being having making taking giving
between without within through because before after during against another several together whether although
question answer problem solution reason result purpose meaning message request response number character letter symbol
username account customer employee manager developer engineer operator service software hardware network database
patience knowledge kindness friendship happiness discipline practice preparation consistency simplicity persistence quality
understanding relationship responsibility opportunity community development management government education experience
necessarily particularly especially generally completely entirely slightly relatively frequently occasionally
geheim falsch richtig erforderlich notwendig abgelaufen gespeichert vergessen sicherheit verschieden nicht wurde werden
incorrecto requerido necesario olvidado caducado seguridad siempre nunca cambiado guardado importante diferente
incorrect requis obligatoire nouveau toujours oubli sauvegarde changement maintenant quelque chose personne""".split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@31!0$57", "aaeiiosst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: power of ten of a large word list, and the power of ten a letter after which a run of letters is no word
LISTED, WORDLIKE = 6.0, 1.35
#: cost of one more segment: attackers try the orders of segments
JOIN = math.log10(2)


def _pool(ch: str) -> float:
    """Power of ten of the characters that a brute-force guess tries at this place."""
    if ch.isascii() and ch.isalnum():
        return 1.0 if ch.isdigit() else math.log10(26)
    return math.log10(33) if ch.isascii() else 2.0


def _neighbours() -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            out.setdefault(a, {})[b] = 1
            out.setdefault(b, {})[a] = -1
    return out


NEXT = _neighbours()


def _walks(low: str):
    """Longest runs along a keyboard row or the alphabet: (start, end, cost)."""
    i = 0
    while i < len(low) - 1:
        j, turns, way = i, 0, 0
        while j + 1 < len(low) and (step := NEXT.get(low[j], {}).get(low[j + 1])):
            turns += step != way
            way, j = step, j + 1
        if j - i >= 3:
            yield i, j + 1, math.log10(47) + math.log10(j - i) + turns * math.log10(4)
            i = j
        else:
            i = max(j, i + 1)


def _repeats(value: str):
    """Longest repeats of a unit of up to eight characters: (start, end, unit, times)."""
    for size in range(1, 9):
        i = 0
        while i + size < len(value):
            j = i
            while j + size < len(value) and value[j] == value[j + size]:
                j += 1
            times = (j - i) // size + 1
            if times >= (3 if size == 1 else 2):
                yield i, i + size * times, value[i: i + size], times
                i += size * (times - 1)
            i += max(1, j - i - size * times) if j > i else 1


def _pairs() -> list[list[float]]:
    """Power of ten of one in how many letters b follows a in words; place 0 is a word's end."""
    n = [[0.25] * 27 for _ in range(27)]
    for word in {w for w in WORDS + PROSE if w.isalpha()}:
        places = [0, *(ord(c) - 96 for c in word), 0]
        for a, b in zip(places, places[1:]):
            n[a][b] += 1
    return [[math.log10(sum(row) / x) for x in row] for row in n]


PAIRS, SAID = _pairs(), frozenset(PROSE)


def wordlike(value: str) -> bool:
    """Are these letters, in the case of a word, that follow each other as in words?"""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c)).replace("ß", "ss")
    if not (plain.isascii() and plain.isalpha() and (value.islower() or value.isupper() or value[1:].islower())):
        return False
    places = [0, *(ord(c) - 96 for c in plain), 0]
    return sum(PAIRS[a][b] for a, b in zip(places, places[1:])) <= WORDLIKE * (len(plain) + 1)


def segments(value: str, ranks: dict[str, int], deep: bool = True) -> list[tuple[int, int, str, float]]:
    """Spans of the value that a pattern guesses: (start, end, kind, power of ten of the guesses)."""
    low = value.lower() if len(value.lower()) == len(value) else value
    out = []
    longest = max(map(len, ranks), default=0)
    for text, extra in ((low, 0.0), (low.translate(LEET), JOIN), (low[::-1], JOIN)):
        if extra and text == low:
            continue
        for i in range(len(text)):
            for n in range(3, min(longest, len(text) - i) + 1):
                if (rank := ranks.get(text[i: i + n])) is not None:
                    a, b = (i, i + n) if text != low[::-1] or not extra else (len(text) - i - n, len(text) - i)
                    capitals = sum(c.isupper() for c in value[a:b])
                    case = 0.0 if not capitals else JOIN if capitals in (1, n) else capitals * JOIN
                    out.append((a, b, "word", math.log10(rank) + case + extra))
    out += [(m.start(), m.end(), "date", math.log10(365 * 120 if m.end() - m.start() > 4 else 120)) for m in DATE.finditer(value)]
    out += [(a, b, "walk", c) for a, b, c in _walks(low)]
    if deep:
        out += [(a, b, "repeat", guesses(unit, ranks, False)[0] + math.log10(times)) for a, b, unit, times in _repeats(value)]
    return out


def guesses(value: str, ranks: dict[str, int], deep: bool = True) -> tuple[float, list[tuple[int, int, str]]]:
    """Least power of ten of the guesses for a value, and the segments that give it."""
    ends: dict[int, list] = {}
    for a, b, kind, cost in segments(value, ranks, deep):
        ends.setdefault(b, []).append((a, kind, cost))
    # best way to each place whose last segment is a pattern, or brute force: cost, start of that segment, kind, kind before
    pattern, brute = [(0.0, 0, "", "")], [(math.inf, 0, "", "")]
    for j in range(1, len(value) + 1):
        way = (math.inf, 0, "", "")
        for a, kind, cost in ends.get(j, ()):
            for before, name in ((pattern[a], "p"), (brute[a], "b")):
                total = before[0] + cost + (JOIN if a else 0)
                if total < way[0]:
                    way = (total, a, kind, name)
        pattern.append(way)
        more, new = brute[j - 1][0], pattern[j - 1][0] + (JOIN if j > 1 else 0)
        one = _pool(value[j - 1])
        brute.append((more + one, brute[j - 1][1], "brute", brute[j - 1][3]) if more <= new else (new + one, j - 1, "brute", "p"))
    j, out = len(value), []
    state = pattern[j] if pattern[j][0] <= brute[j][0] else brute[j]
    best = state[0]
    while j:
        out.append((state[1], j, state[2]))
        j, state = state[1], (pattern if state[3] == "p" else brute)[state[1]]
    return best, out[::-1]


def find(text: str, ranks: dict[str, int], strong: float = STRONG) -> list[tuple[int, int, int, float | None]]:
    """Spans of a text by start, then kind: (kind number, start, end, power of ten of the guesses)."""
    low = text.lower()
    out = []
    if any(n in low for n in NAMES):
        out += [(0, m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(n in low for n in PLACE_NAMES):
        base = sorted((a, b) for _, a, b, _ in out)
        for m in PLACE.finditer(text):
            a, value = m.start("value"), m["value"].rstrip(".!?)")
            b = a + len(value)
            if any(x < b and a < y for x, y in base):
                continue
            cost = guesses(value, ranks)[0]
            if cost >= strong and (value.lower() in SAID or m["said"] and wordlike(value)):
                cost = min(cost, LISTED)
            if cost >= strong:
                out.append((3, a, b, cost))
    return sorted(out, key=lambda s: (s[1], s[0]))


def masked(text: str, spans: list[tuple], mask: str) -> str:
    """The text with its spans, overlapping ones together, replaced by ``mask``."""
    parts, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame, *, text: str = "text", spans: str = "spans", mask: str | None = None, words: list[str] | None = None,
         strong: float = STRONG) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, guesses); a column of that name is replaced.

    With ``mask``, the spans of the text are replaced by it. ``words`` is the dictionary, most frequent first.
    """
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(words or WORDS)))}
    kept = [f.name for f in docs.schema.fields if f.name != spans]
    made = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                     T.StructField("end", T.IntegerType()), T.StructField("guesses", T.DoubleType())]), False)
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField(spans, made, False)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find(t, ranks, strong) if t else [] for t in texts]
            columns = {k: batch.column(k) for k in kept}
            if mask is not None:
                columns[text] = pa.array([masked(t, s, mask) if s else t for t, s in zip(texts, found)], batch.column(text).type)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "guesses": g} for k, a, b, g in s] for s in found]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, arrow)], names=[*kept, spans])

    return docs.mapInArrow(run, schema)


def listed(spans, base: bool):
    """``kind:start:end`` of spans, comma-joined, as a column; base kinds only, or all."""
    chosen = F.filter(spans, lambda s: s["kind"] != KINDS[-1]) if base else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
