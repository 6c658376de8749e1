"""Personal data replaced by keyed surrogates.

Detected entities are cut into atoms (a telephone number's digits, a surname,
an e-mail address), so that every mention of an atom, however it is punctuated
or capitalised, gets the same surrogate. A surrogate is drawn from a keyed hash
of type and atom: digits stand for digits, letters for letters of the same
script and case, card numbers and IBANs keep valid check digits, given names
turn into other given names of the same gender and script, addresses stay
routable or private as they were. Candidates that two atoms share, or that are
themselves an atom of the corpus, are drawn anew until all are distinct.

Persons are found behind a title (up to ``RUN`` capitalised words after it, given
names outside the lists among them) or by a given name of the lists below, no other
way; a name found so is replaced in the rest of its text too, where it stands
alone. Given names come from short lists, and private addresses from blocks that a corpus may use up,
so those are permuted as a whole: distinct by construction and never themselves.

Edge cases: a null text stays null and an empty one empty; repeated rows get
equal texts; a text of any length is read whole; an empty table gives no rows;
all columns of the input are returned as they are but for the text, and columns
of the input whose names begin with ``_pii`` do not occur in practice and are
refused.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

KEY = b"tessella surrogates"

# Given names by script and gender, titles, surname syllables.
GIVEN = {
    ("latin", "f"): ["Anna", "Barbara", "Camille", "Carmen", "Charlotte", "Claire", "Elena", "Emily", "Emma", "Greta", "Hannah", "Helga", "Ingrid", "Isabel", "Jessica", "Julia", "Katrin", "Laura", "Linda", "Lucia", "Marie", "Mary", "Monique", "Nathalie", "Olivia", "Patricia", "Sarah", "Sophie", "Susan", "Ursula"],
    ("latin", "m"): ["Antoine", "Bernd", "Carlos", "Charles", "Daniel", "David", "Diego", "Emile", "Felix", "Fritz", "George", "Henri", "Hans", "James", "Javier", "John", "Jorge", "Klaus", "Louis", "Lukas", "Michael", "Miguel", "Pablo", "Pierre", "Robert", "Stefan", "Thomas", "Walter", "William", "Wolfgang"],
    ("cyrillic", "f"): ["Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"],
    ("cyrillic", "m"): ["Александр", "Андрей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"],
    ("greek", "f"): ["Αικατερίνη", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γεώργιος", "Δημήτριος", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος"],
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra"]
SYLLABLES = {
    "latin": ["bar", "bel", "ber", "cor", "dan", "del", "dor", "fal", "fen", "gar", "gol", "hal", "hen", "jor", "kal", "kel", "lan", "ler", "lin", "mar", "mel", "min", "nor", "pal", "per", "ral", "ros", "sal", "ser", "sten", "tal", "tor", "val", "ver", "wel", "win"],
    "cyrillic": ["бар", "бел", "вол", "гор", "дан", "зор", "кал", "кор", "лен", "лис", "мар", "мел", "нор", "пол", "рад", "сем", "тар", "фед"],
    "greek": ["βαρ", "γαλ", "δεν", "ζαρ", "καλ", "κορ", "λεν", "μαρ", "μελ", "νικ", "παν", "ραλ", "σαρ", "τορ", "φαλ", "χαρ"],
}
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PL": 28, "PT": 25}

#: Capitalised words behind a title that are taken as its name.
RUN = 3

_GENDER = {n.lower(): k for k, names in GIVEN.items() for n in names}
_NAMES = "|".join(sorted({x for names in GIVEN.values() for n in names for x in (n, n.upper())}, key=lambda n: (-len(n), n)))
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w'’-]+"
_TITLE = "|".join(TITLES)

# Order matters: where two patterns begin at one place the earlier one is taken.
_PATTERNS = {
    "email": r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|token)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_.~!@#$%^&*-]{6,}[A-Za-z0-9+/_=])",
    "key": r"\b(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xoxb-|AIza)[A-Za-z0-9_-]{12,}",
    "iban": r"\b(?:" + "|".join(rf"{c}\d{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + r")\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w.-])\+\d{8,15}(?!\d)",
    "person": rf"\b(?:(?:(?:{_TITLE})\b\.?[ ])+(?:(?:[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]\.[ ]?)*{_CAP}(?:[ ](?={_CAP}))?){{1,{RUN}}}|(?:{_NAMES})[ ]{_CAP})",
}
_ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: Every pattern needs one of these (as the JVM's regular expressions have it); texts without them are passed on as they are.
MAY_HOLD = rf"[\p{{Nd}}@=:]|(?=[A-Z\x{{370}}-\x{{4FF}}])(?:{_TITLE}|{_NAMES}|AIza|AKIA|ASIA)|(?=[gsx])(?:ghp_|gho_|sk-|sk_|xoxb)"


_OWNER = re.compile(r"['’]s$")
_WORDS = re.compile(r"(?<![\w'’-])\w+(?:['’-][\w]+)*")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[\u0400-\u04ff]", word) else "greek" if re.search("[\u0370-\u03ff]", word) else "latin"


def find_entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, atom) of what is to be replaced, in order and without overlap.

    Names that stand in a full match are also found wherever else the text has them alone.
    """
    found = list(_matches(text))
    names = {atom: kind for _, _, kind, atom in found if kind in ("given", "surname")}
    if not names:
        yield from found
        return
    at = 0
    for a, b, *entity in [*found, (len(text), len(text))]:
        for m in _WORDS.finditer(text, at, a):
            word = _OWNER.sub("", m.group())
            # Only words written like a name: "Weber", not "weber".
            if word[0].isupper() and (kind := names.get(word.lower())) and not (m.end() == a < len(text) and text[a].isalnum()):
                yield m.start(), m.start() + len(word), kind, word.lower()
        if entity:
            yield a, b, *entity
        at = b


def _matches(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _ENTITY.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        if m.group("value") is not None:
            yield *m.span("value"), "secret", m.group("value")
            continue
        value = m.group()
        if kind == "person":
            yield from _name_parts(value, a)
            continue
        digits = re.sub(r"\D", "", value)
        if kind == "card" and not luhn(digits):
            # a long number that is no card, or a telephone number
            kind = "phone" if value.startswith("+") or len(digits) <= 15 and re.search("[ -]", value) else "number"
        if kind == "phone" and not (value.startswith("+") or "(" in value or 9 <= len(digits) <= 15):
            continue
        if kind in ("card", "phone", "number", "ssn"):
            skip = re.match(r"\+\d{1,3}(?=[ .(-])", value)
            a += skip.end() if skip else 0
            yield a, b, kind, re.sub(r"\D", "", value[skip.end() if skip else 0 :])
        elif kind == "ip" and _private(value):
            yield a, b, "private_ip", ".".join(str(int(x)) for x in value.split("."))
        elif kind == "iban":
            yield a, b, kind, value.replace(" ", "")
        else:
            yield a, b, kind, value.lower() if kind == "email" else value


def _private(address: str) -> int:
    """Host bits of the private or loopback block that the address lies in, 0 for other addresses."""
    first, second = (int(x) for x in address.split(".")[:2])
    return 24 if first in (10, 127) else 16 if (first, second) == (192, 168) else 20 if first == 172 and 16 <= second < 32 else 0


def _shuffled(key: bytes, name: str, x: int, bits: int, back: bool = False) -> int:
    """A keyed permutation of the numbers of an even count of bits (or its inverse), by balanced rounds."""
    half = bits // 2
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for r in range(7, -1, -1) if back else range(8):
        mixed = lambda v: int.from_bytes(hmac.new(key, f"{name}|{r}|{v}".encode(), hashlib.sha256).digest()[:4], "big") & mask
        left, right = (right ^ mixed(left), left) if back else (right, left ^ mixed(right))
    return left << half | right


def _neighbour(key: bytes, name: str, x: int, bits: int) -> int:
    """The number behind ``x`` in a keyed order of all numbers of that many bits: one to one, never ``x`` itself."""
    return _shuffled(key, name, (_shuffled(key, name, x, bits, back=True) + 1) % (1 << bits), bits)


def _name_parts(value: str, at: int) -> Iterator[tuple[int, int, str, str]]:
    for m in re.finditer(r"[\w'’]+(?:-[\w'’]+)*", value):
        word = _OWNER.sub("", m.group())
        if word in TITLES or len(word) == 1:  # initials tell nothing
            continue
        kind = "given" if word.lower() in _GENDER else "surname"
        yield at + m.start(), at + m.start() + len(word), kind, word.lower()


class Stream:
    """Numbers from a keyed hash of a type, an atom and the attempt."""

    def __init__(self, key: bytes, kind: str, atom: str, attempt: int):
        self.key, self.name, self.block, self.held = key, f"{kind}|{atom}|{attempt}", 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, f"{self.name}|{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        x, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return x % n


def _like(value: str, s: Stream) -> str:
    """Digits for digits and letters for letters of the same case and script."""
    if re.fullmatch("[0-9a-f]{8,}", value) and not value.isdigit():
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    out = []
    for i, c in enumerate(value):
        if c.isdigit():
            out.append("0123456789"[s.below(10)] if i or c == "0" else "123456789"[s.below(9)])
        elif c.isalpha():
            pool = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[script_of(c)]
            x = pool[s.below(len(pool))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def candidate(key: bytes, kind: str, atom: str, attempt: int) -> str:
    """The surrogate of an atom at the given attempt, itself an atom of the same type and format."""
    s = Stream(key, kind, atom, attempt)
    if kind == "given":
        names = sorted((n.lower() for n in GIVEN[_GENDER[atom]]), key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return names[(names.index(atom) + 1) % len(names)]
    if kind == "surname":
        pool = SYLLABLES[script_of(atom)]
        part = lambda: "".join(pool[s.below(len(pool))] for _ in range(3 + attempt // 4))
        return "-".join(part() for _ in atom.split("-"))
    if kind == "email":
        local, _, domain = atom.rpartition("@")
        labels = domain.split(".")
        return f"{_like(local, s)}@{'.'.join([*(_like(x, s) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        return ".".join([str(11 + s.below(116)), *(str(1 + s.below(254)) for _ in range(3))])
    if kind == "private_ip":
        bits = _private(atom)
        whole = int.from_bytes(bytes(int(x) for x in atom.split(".")), "big")
        block = whole >> bits
        host = _neighbour(key, f"private_ip|{block}", whole & (1 << bits) - 1, bits)
        return ".".join(str(x) for x in (block << bits | host).to_bytes(4, "big"))
    if kind == "card":
        body = atom[0] + "".join(str(s.below(10)) for _ in atom[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "number":  # must not turn into a card number
        body = _like(atom[:-1], s)
        last = s.below(10)
        return body + str(next(d % 10 for d in range(last, last + 10) if not luhn(body + str(d % 10))))
    if kind == "iban":
        body = _like(atom[4:], s)
        turned = "".join(str(int(c, 36)) for c in body + atom[:2] + "00")
        return f"{atom[:2]}{98 - int(turned) % 97:02d}{body}"
    if kind == "key":
        prefix = re.match("AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xoxb-|AIza", atom).group()
        return prefix + _like("x" + atom[len(prefix) :], s)[1:]
    return _like(atom, s)


def render(mention: str, kind: str, surrogate: str) -> str:
    """The surrogate in the punctuation and case of a mention."""
    if kind in ("card", "phone", "number", "ssn", "iban"):
        rest = iter(surrogate)
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind in ("given", "surname"):
        if mention.isupper() and len(mention) > 1:
            return surrogate.upper()
        return "-".join(w[:1].upper() + w[1:] for w in surrogate.split("-")) if mention[:1].isupper() else surrogate
    if kind == "email":
        return surrogate.upper() if mention.isupper() else surrogate
    return surrogate


def surrogates(atoms: DataFrame, key: bytes = KEY, max_rounds: int = 64) -> DataFrame:
    """(kind, atom, surrogate) for distinct (kind, atom) rows, one to one and apart from all atoms.

    A round draws a candidate for every open atom. Of those who share a
    candidate the least atom keeps it; candidates that are an atom, or were
    given away before, go back. Given names and private addresses are permuted and need no check.
    """

    def draw(attempt: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"kind": b["kind"], "atom": b["atom"], "surrogate": [candidate(key, k, a, attempt) for k, a in zip(b["kind"], b["atom"])]})

        return run

    schema = "kind string, atom string, surrogate string"
    permuted = F.col("kind").isin("given", "private_ip")
    done = written(atoms.where(permuted).mapInPandas(draw(0), schema), "permuted")
    open_ = atoms.where(~permuted)
    for attempt in range(max_rounds):
        drawn = written(open_.mapInPandas(draw(attempt), schema), "drawn")
        taken = atoms.select("kind", F.col("atom").alias("surrogate")).union(done.select("kind", "surrogate"))
        first = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("atom").alias("atom"))
        done = written(done.union(first.select("kind", "atom", "surrogate")), "settled")
        open_ = drawn.select("kind", "atom").join(done, ["kind", "atom"], "left_anti")
        if not open_.take(1):
            return done
        open_ = written(open_, "open")
    raise RuntimeError("a format has fewer values than the corpus has entities of it")


def replace_entities(docs: DataFrame, *, text_col: str = "text", key: bytes = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with every detected entity of ``text_col`` replaced; ``count_col`` adds the number of mentions."""
    if any(c.startswith("_pii") for c in docs.columns):
        raise ValueError("column names that begin with _pii are taken")
    text = F.col(text_col)
    may = F.coalesce(text.rlike(MAY_HOLD), F.lit(False))
    mark = F.sha2(text.cast("binary"), 256)

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, k, a) for m, t in zip(b["_pii_mark"], b["t"]) for k, a in {(k, a) for _, _, k, a in find_entities(t)}]
            yield pd.DataFrame(rows, columns=["mark", "kind", "atom"])

    # Copies of a text share their mentions; they are brought together by the text's hash.
    found = written(docs.where(may).select(mark.alias("_pii_mark"), text.alias("t")).mapInPandas(mentions, "mark string, kind string, atom string").distinct(), "mentions")
    named = surrogates(written(found.select("kind", "atom").distinct(), "atoms"), key)
    per_text = found.join(named, ["kind", "atom"]).groupBy(F.col("mark").alias("_pii_key")).agg(F.collect_list(F.struct("kind", "atom", "surrogate")).alias("_pii_map"))
    per_text = written(per_text, "maps")

    def swap(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, m in zip(texts, maps):
            table = {(x["kind"], x["atom"]): x["surrogate"] for x in (m if m is not None else ())}
            parts, at, seen = [], 0, 0
            for a, b, kind, atom in find_entities(t):
                parts += [t[at:a], render(t[a:b], kind, table[kind, atom])]
                at, seen = b, seen + 1
            out.append("".join([*parts, t[at:]]))
            n.append(seen)
        return pd.DataFrame({"t": out, "n": n})

    swapped = F.pandas_udf(swap, "t string, n long")
    others = [c for c in docs.columns if c != text_col]
    order = [*docs.columns, *([count_col] if count_col else [])]
    touched = docs.where(may).withColumn("_pii_mark", mark).join(per_text, F.col("_pii_mark") == F.col("_pii_key"), "left").withColumn("_pii_new", swapped(text, "_pii_map"))
    touched = touched.select(*others, F.col("_pii_new.t").alias(text_col), *([F.col("_pii_new.n").alias(count_col)] if count_col else []))
    rest = docs.where(~may)
    if count_col:
        rest = rest.withColumn(count_col, F.lit(0).cast("long"))
    return touched.select(*order).unionByName(rest.select(*order))
