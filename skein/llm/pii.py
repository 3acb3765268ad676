"""Personal information in free text: found, and replaced by typed placeholders that keep equal values linked.

Items are found by their form, checked (digit groups, lengths, check ranges) and, where the form alone is ambiguous, by
the words before them. Given names are learned from the texts themselves: what people write after "my name is" and the like
labels them. A placeholder holds a pseudonym of the same format: the digits and letters of the item are
permuted by a keyed Feistel network, so that the same value gets the same pseudonym in every document, no two values
share one, and whoever holds the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator, Set

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most given names that are learned.
LEXICON = 100_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Words that come before an item, in the six languages.
PHONE_CUES = "call|call me|call us|ringing|ring me|ring us|phone|mobile|cell|my number is|number is|tel|text|text me|whatsapp|fax|reach me|teléfono|móvil|celular|llám\\w*|appelez\\S*|téléphone|portable|nummer|anrufen|ruf mich|rufen|telefon\\w*|erreich\\w*|bitte unter|unter der|ligue|telefone|позвон\\w*|телефон\\w*|мой номер"
ID_CUES = "social security|ssn|national id|\\bid\\b|identity|identité|identidad|passport|passeport|pasaporte|passaporte|reisepass|ausweis|steuer|tax|ni number|insurance|dni|nif|nie|cpf|cnpj|rfc|curp|инн|снилс|паспорт|fiscal"
PLACE_CUES = "live at|living at|moved to|deliver|go to|goes to|came to|come to|address|send it to|ship|wohne|anschrift|adresse|habite|vivo en|dirección|moro|endereço|живу|адрес|lieferung|entreg|livr"
NAME_CUES = "my name is|name is|name:|ask for|asked for|signed for by|signed by|it was|booked for|account is under|registered to|in the name of|on behalf of|speak to|spoke to|talk to|mein name ist|ich heiße|ich heisse|läuft auf|auf den namen|au nom de|je m'appelle|je m’appelle|a nombre de|me llamo|mi nombre es|em nome de|meu nome é|me chamo|меня зовут|на имя|mr|mrs|ms|miss|herr|frau|señor|señora|monsieur|madame"
STREETS = "street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd"
#: Also common words: these need a cue or a capital.
STREETS_TOO = "drive|dr|court|ct|close|way|place|pl|square|sq|terrace|crescent|grove|gardens|row|mews|hill"
GIVEN = set(
    "adam aiko aisha alba alejandro alex alexander ali alice amara amelia amina amy ana anaïs andrea andrei andrew anna anne anton antonio "
    "beatriz ben boris bruno camille carla carlos carmen carol charlotte chloe chris clara claire claudia daniel dario david declan diego dmitri "
    "elena elias elif emil emily emma eric erik eva fatima felix fernanda francois françois freya gabriel george greta hana hannah hans helen henrik henry hugo "
    "ibrahim igor ilse ines inês irina isabel ivan ivo jack james jan jean jennifer joan joana joão john jonas josé jose juan julia jürgen karl kate "
    "katja kofi kwame lars laura lea leo lena linda lucas lucia lucía luis maja marco maren maria maría marie mark marta martin mary mateo max mei michael mia mohamed "
    "natalia nikolai nils nina noah noemi olga olivia omar oskar pablo paul paula pedro peter petra pierre priya rachel rafael ravi richard robert rosa ruben "
    "salma samuel sara sarah sergei sofia sophie stefan susan talia tariq thomas tobias tom viktor william yara yuki yusuf zoë zoe".split()
)

_AT = r"(?:\s?[\[(]\s?(?:at|ät|arroba)\s?[\])]\s?|\s(?:at|ät|arroba)\s)"
_DOT = r"(?:\s?[\[(]\s?(?:dot|punto|punkt|point|ponto)\s?[\])]\s?|\s(?:dot|punto|punkt|ponto)\s)"
_PART = r"[^\W_][\w+%-]*"
EMAIL = re.compile(rf"(?<![\w@.])(?:{_PART}(?:\.{_PART})*@{_PART}(?:\.{_PART})+|{_PART}(?:(?:\.|{_DOT}){_PART})*{_AT}{_PART}(?:(?:\.|{_DOT}){_PART})*{_DOT}{_PART}|{_PART}(?:\.{_PART})*\s?[\[(]\s?at\s?[\])]\s?{_PART}(?:\.{_PART})+)", re.I)
NUMBER = re.compile(r"(?<![\w.,/#:$€£+-])(?:\+\s?)?(?:\(\d{1,5}\)|\d+)(?:(?:[ .\-/\xa0]{1,2}|(?<=\)))(?:\(\d{1,5}\)|\d+))*(?![\w])")
ID = re.compile(
    r"(?<![\w-])(?:[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d]|[a-z]{2}\d{7}|\d{8}-?[a-z]|\d{2}\.\d{3}\.\d{3}-?[a-z]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}([- ])\d{2}\1\d{4}|\d{9})(?![\w-])(?!\.\d)",
    re.I,
)
_NUM = r"\d{1,4}[a-z]?"
_CAP = r"[^\W\d_][\w'’]*"
ADDRESS = re.compile(
    rf"(?<![\w.,:/-])(?:{_NUM}\s(?:{_CAP}\s){{1,3}}?(?P<strong>{STREETS})\b|{_NUM}\s(?:{_CAP}\s){{1,3}}?(?P<weak>{STREETS_TOO})\b"
    rf"|{_NUM},?\s(?:rue|avenue|chemin|boulevard|place|allée|impasse|quai)\s(?:de la |de l'|de |du |des |d')?{_CAP}"
    rf"|(?:calle|avenida|av\.|plaza|paseo|rua|travessa|carrera|camino)\s(?:de la |de los |de |da |do |dos )?{_CAP}(?:\s{_CAP})?,?\s(?:n[ºo°.]\s?)?{_NUM}"
    rf"|[^\W\d_][\w-]*?(?:straße|strasse|str\.|str|weg|allee|platz|gasse|damm|ufer)\s{_NUM})(?![\w-])",
    re.I,
)
_TOKEN = r"[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*"
NAME = re.compile(rf"(?:\b(?P<cue>{NAME_CUES})\.?\s+)(?P<name>(?P<a>{_TOKEN})(?P<comma>,)?\s(?:[^\W\d_]\.\s?){{0,2}}(?P<b>{_TOKEN}))", re.I)
_REST = r"[^\W\d_'’]*(?:['’-][^\W\d_]+)*"
#: A capitalised word before another one; the second is only looked at, as it may be the first of the next pair.
BARE_NAME = re.compile(rf"(?<![\w@#.+-])(?P<a>[^\W\d_a-z]{_REST})(?=\s(?:[^\W\d_]\.\s)?(?P<b>[^\W\d_a-z]{_REST}))")
BIRTH = re.compile(r"(?:born(?: on)?|date of birth|dob|geboren(?: am)?|née? le|nacid[oa] el|nascid[oa] em|родил\w+)[:\s]+(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})", re.I)
_PHONE_CUE = re.compile(rf"\b(?:{PHONE_CUES})\b\.?[^.!?\d]{{0,14}}$", re.I)
_ID_CUE, _PLACE_CUE = (re.compile(rf"(?:{c})[^.!?]{{0,24}}$", re.I) for c in (ID_CUES, PLACE_CUES))
_CASE_CUE = re.compile(r"(?:order|case|ticket|serial|error|code|log|ref\w*|message|notice|sheet|pedido|bestellung|commande|vorgang|caso|erro\w*|chamado|заказ|номер заказа|see|under|as)\W{1,3}$", re.I)
_STREET_WORDS = frozenset(f"{STREETS}|{STREETS_TOO}".split("|"))
_WEAK = {"it was", "ask for", "asked for", "booked for", "talk to", "speak to", "spoke to", "name:", "name is", "signed by", "miss", "ms"}


def value(item: str) -> str:
    """An item reduced to its letters and digits, lower-cased."""
    return "".join(c for c in item.lower() if c.isalnum())


def _is_phone(item: str, before: str) -> bool:
    groups = re.findall(r"\d+", item)
    digits = "".join(groups)
    if len(digits) < 7:
        return False
    if item.startswith("+") or re.match(r"00[1-9]", item):
        return 8 <= len(digits) <= 15
    cued = bool(_PHONE_CUE.search(before)) and not _CASE_CUE.search(before)
    if len(groups) == 1:
        return cued and 10 <= len(digits) <= 15
    sizes = [len(g) for g in groups]
    if "." in item and sizes not in ([3, 3, 4], [1, 3, 3, 4]) and set(sizes) != {2}:
        return False  # a version, a date or an amount
    if sizes[-3:] == [3, 3, 4] and len(groups) <= 4 and (len(groups) == 3 or groups[0] in ("1", "001")):
        return True
    if digits[0] == "0" and 9 <= len(digits) <= 14 and not re.fullmatch(r"\d{2}-\d{7}-\d{2}", item):
        return cued or (" " in item and len(groups) >= 3)
    return cued and 8 <= len(digits) <= 15


def _is_cued(m: re.Match) -> bool:
    """Two capitalised words after a cue that hardly anything but a name follows."""
    a, b = m["a"], m["b"]
    return not m["comma"] and m["cue"].lower() not in _WEAK and a[0].isupper() and b[0].isupper() and len(b) > 1


def _is_name(m: re.Match, given: Set[str]) -> bool:
    return (m["b"] if m["comma"] else m["a"]).lower() in given or _is_cued(m)


def learn_names(docs: DataFrame, text: str = "text", times: int = 3, most: int = LEXICON) -> frozenset[str]:
    """Given names that the texts introduce: words that come capitalised after a cue at least ``times``, with several family names.

    All texts count. The ``most`` frequent ones are kept, a bound far above the given names of any language, which keeps what is
    broadcast small. Null texts teach nothing.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m["a"].lower(), m["b"].lower()) for t in batch.column(0).to_pylist() if "name" in signals(t) for m in NAME.finditer(t.translate(_SPACES)) if _is_cued(m) and m["b"].lower() not in _STREET_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["a", "b"])

    seen = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(over, "a string, b string")
    counts = seen.groupBy("a").agg(F.count("*").alias("n"), (F.min("b") < F.max("b")).alias("several")).where(F.col("several") & (F.col("n") >= times))
    return frozenset(r["a"] for r in counts.orderBy(F.desc("n"), "a").limit(most).collect())


def _signals() -> ahocorasick.Automaton:
    """Finds, in one pass over a text, the words without which no address, name, birth date or spelled-out e-mail is there."""
    out, plain = ahocorasick.Automaton(), str.maketrans({"\\": "", ".": " "})
    words = {f" {c.strip(':')} ": "name" for c in NAME_CUES.split("|")}
    words |= {f" {c} ": "place" for c in f"{STREETS}|{STREETS_TOO}|rue|chemin|place|allée|impasse|quai|calle|avenida|av|plaza|paseo|rua|travessa|carrera|camino".split("|")}
    words |= {f"{c} ": "place" for c in "straße|strasse|str|weg|allee|platz|gasse|damm|ufer".split("|")}
    words |= {f" {c} ": "email" for c in "at|ät|arroba".split("|")}
    words |= {c: "birth" for c in ("born", "birth", " dob ", "geboren", " né ", " née ", "nacid", "nascid", "родил")}
    for word, what in words.items():
        out.add_word(word.translate(plain), what)
    out.make_automaton()
    return out


_SIGNALS = _signals()
#: Other spaces count as plain ones; places in the text stay the same.
_SPACES = str.maketrans(dict.fromkeys("\xa0\u2007\u2009\u202f\u3000\t", " "))
_MARKS = str.maketrans({c: " " for c in ".,;:!?()[]{}\"\n\t\r\xa0"})


def signals(text: str) -> set[str]:
    """The kinds of items of which a text holds a signal word."""
    return {what for _, what in _SIGNALS.iter(f" {text.translate(_SPACES).lower().translate(_MARKS)} ")}


def find(text: str, given: Set[str] = GIVEN) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, none overlapping; ``given`` are the given names known."""
    found: list[tuple[int, int, str]] = []
    text = text.translate(_SPACES)

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in found):
            found.append((start, end, kind))

    spaced = f" {text.lower().translate(_MARKS)} "
    told = {what for _, what in _SIGNALS.iter(spaced)}
    if text.count("@") > text.count(" @") + text.startswith("@") or ("email" in told and (" dot " in spaced or "(" in text or "[" in text or " punkt " in spaced or " punto " in spaced or " ponto " in spaced)):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if "birth" in told:
        for m in BIRTH.finditer(text):
            add(m.start(1), m.end(1), "birth_date")
    for m in ID.finditer(text):
        before = text[: m.start()]
        if (len(m[0]) > 9 or not m[0].isdigit() or _ID_CUE.search(before)) and not before.endswith("+"):
            add(m.start(), m.end(), "id_number")
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and _is_phone(m[0], text[: m.start()]):
            add(m.start(), m.end(), "phone")
    if "place" in told:
        for m in ADDRESS.finditer(text):
            if not m["weak"] or _PLACE_CUE.search(text[: m.start()]) or all(w[0].isupper() for w in m[0].split()[1:]):
                add(m.start(), m.end(), "address")
    if "name" in told:
        for m in NAME.finditer(text):
            if _is_name(m, given):
                add(m.start("name"), m.end("name"), "name")
    if not given.isdisjoint(spaced.split()) and not text.isupper():
        for m in BARE_NAME.finditer(text):
            # Not in capitals throughout, as words of headlines are, and not after or before a number, as months and products are.
            whole = m["a"][0].isupper() and m["b"][0].isupper() and not (m["a"].isupper() and m["b"].isupper())
            beside = text[: m.start()].rstrip()[-1:].isdigit() or text[m.end("b") :].lstrip()[:1].isdigit()
            if whole and m["a"].lower() in given and not beside:
                add(m.start(), m.end("b"), "name")
    return sorted(found)


def _feistel(digits: list[int], base: int, key: bytes, undo: bool = False) -> list[int]:
    """A keyed permutation of the strings of this length over ``base`` symbols: ten rounds on unequal halves."""
    n = len(digits)
    if n < 2:
        shift = hmac.new(key, b"one%d" % base, hashlib.sha256).digest()[0]
        return [(d + (-shift if undo else shift)) % base for d in digits]
    half = n // 2
    a, b = digits[:half], digits[half:]

    def number(x: list[int]) -> int:
        out = 0
        for d in x:
            out = out * base + d
        return out

    def symbols(v: int, size: int) -> list[int]:
        out = []
        for _ in range(size):
            v, d = divmod(v, base)
            out.append(d)
        return out[::-1]

    def f(i: int, x: list[int]) -> int:
        return int.from_bytes(hmac.new(key, b"%d/%d/%d/" % (i, n, base) + bytes(x), hashlib.sha256).digest(), "big")

    for i in reversed(range(10)) if undo else range(10):
        # Even rounds change the first half by the second, odd ones the second by the first.
        src, dst = (b, a) if i % 2 == 0 else (a, b)
        new = symbols((number(dst) + (-f(i, src) if undo else f(i, src))) % base ** len(dst), len(dst))
        a, b = (new, b) if i % 2 == 0 else (a, new)
    return a + b


def pseudonym(item: str, key: bytes, undo: bool = False) -> str:
    """The item with its digits and its letters permuted, in its own format: length, case and marks stay.

    Letters with accents count as their base letters; letters of other scripts stay as they are.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKD", item) if not unicodedata.combining(c))
    digit_at = [i for i, c in enumerate(plain) if c in "0123456789"]
    letter_at = [i for i, c in enumerate(plain) if c.isascii() and c.isalpha()]
    out = list(plain)
    for i, d in zip(digit_at, _feistel([int(plain[i]) for i in digit_at], 10, key, undo), strict=True):
        out[i] = str(d)
    for i, d in zip(letter_at, _feistel([ord(plain[i].lower()) - 97 for i in letter_at], 26, key, undo), strict=True):
        out[i] = chr(97 + d).upper() if plain[i].isupper() else chr(97 + d)
    return "".join(out)


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


def date_pseudonym(item: str, key: bytes, undo: bool = False) -> str:
    """A valid date of 1900 to 2099 as another one, in the same order and with the same marks; other items as numbers."""
    parts = re.split(r"(\D)", item)
    nums = parts[0::2]
    year_first = len(nums[0]) == 4
    y, m, d = (int(x) for x in (nums if year_first else nums[::-1]))
    try:
        day = datetime.date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return pseudonym(item, key, undo)
    if not 0 <= day < _DAYS:
        return pseudonym(item, key, undo)
    while True:  # walks the cycle of a permutation of 100,000 numbers until it meets a date
        day = int("".join(map(str, _feistel([int(c) for c in f"{day:05d}"], 10, key, undo))))
        if day < _DAYS:
            break
    new = datetime.date.fromordinal(day + _FIRST)
    vals = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
    return parts[1].join(vals if year_first else vals[::-1])


def redact(text: str, key: bytes, given: Set[str] = GIVEN) -> str:
    """The text with every item replaced by ``[KIND pseudonym]``."""
    out, done = [], 0
    for start, end, kind in find(text, given):
        cover = date_pseudonym if kind == "birth_date" else pseudonym
        out += [text[done:start], f"[{kind.upper()} {cover(text[start:end], key)}]"]
        done = end
    return "".join([*out, text[done:]])


def items(docs: DataFrame, key: str = "tweet_id", text: str = "text", names: Set[str] = frozenset()) -> DataFrame:
    """(key, kind, item, value, start, end) of every personal item; null texts and keys have none. ``names`` are given names learned.

    Kinds are email, phone, id_number, address, name and birth_date; ``start`` and ``end`` count code points. A key given more
    than once gives its items each time. Extra columns are ignored; an empty table has no items.
    """

    shared = docs.sparkSession.sparkContext.broadcast(frozenset(GIVEN | names))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        for batch in batches:
            rows = [(k, kind, t[a:b], value(t[a:b]), a, b) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, kind in find(t, given)]
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "kind", "item", "value", "start", "end"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("key", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return rows.mapInArrow(over, "key string, kind string, item string, value string, start int, end int")


def redacted(c: Column, secret: str, names: Set[str] = frozenset()) -> Column:
    """A text column with its personal items replaced; null stays null. ``names`` are given names learned."""
    given = frozenset(GIVEN | names)

    @F.pandas_udf("string")
    def run(texts):
        key = secret.encode()
        return texts.map(lambda t: redact(t, key, given), na_action="ignore")

    return run(c)


def audit(found: DataFrame, secret: str) -> DataFrame:
    """One row (linked, inverted) about the pseudonyms of the items of :func:`items`: whether equal items and only they share one,
    and whether each leads back to its item."""

    @F.pandas_udf("struct<plain:string,alias:string,back:boolean>")
    def run(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        key, rows = secret.encode(), []
        for kind, t in zip(kinds, texts, strict=True):
            cover = date_pseudonym if kind == "birth_date" else pseudonym
            plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
            alias = cover(t, key)
            rows.append((plain, alias, cover(alias, key, True) == plain))
        return pd.DataFrame(rows, columns=["plain", "alias", "back"])

    each = found.groupBy("kind", "item").agg(F.lit(1).alias("one")).select("kind", run("kind", "item").alias("p")).select("kind", "p.*")
    pairs = each.groupBy("kind", "plain", "alias").agg(F.bool_and("back").alias("back"))
    per = pairs.groupBy("kind", "alias").agg(F.count("*").alias("n"), F.bool_and("back").alias("back")).agg(F.max("n").alias("n"), F.bool_and("back").alias("back"))
    per_item = pairs.groupBy("kind", "plain").agg(F.count("*").alias("m")).agg(F.max("m").alias("m"))
    return per.join(F.broadcast(per_item)).select((F.coalesce("n", F.lit(1)) * F.coalesce("m", F.lit(1)) == 1).alias("linked"), F.coalesce("back", F.lit(True)).alias("inverted"))
