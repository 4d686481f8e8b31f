"""Text that looks the same, in one form (problem 2).

Method: a compiled longest-match transducer over grapheme clusters. The table
is computed once from the Unicode database (widths, ligatures, styled and
otherwise duplicate letters, separate accents, spaces, invisible characters,
hyphens) and checked for conflicts; look-alike letters of other scripts have a
table of their own. The compiled matcher goes through a text once: it runs over
plain stretches at regex speed, and each run of word characters that holds a
trigger is rewritten cluster by cluster, longest cluster first, before its
look-alikes are settled.

Look-alikes: in a word that mixes scripts the letters that have no double in
the other script decide what the word is written in; the rest follow. A word
made of look-alikes only is judged by the text: by what it is tied to without
a space, then by its neighbours on the line, then by the line. Words of another
script stay as they are, and so do raised digits, fractions, typographic quotes
and dashes.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: Capital and small letters that look like a Latin one, by script.
LOOKALIKES = {
    "CYRILLIC": ("АВЕЅІЈКМНОРСТУХҮԚԜаеіјорсухѕһԁԛԝ", "ABESIJKMHOPCTYXYQWaeijopcyxshdqw"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿνοϲϳ", "ABEZHIKMNOPTYXCJvocj"),
    "ARMENIAN": ("ՕՍօոցսհզ", "OUonguhq"),
}
#: Hyphens that look like the plain one.
HYPHENS = "\u2010\u2011\u058a\ufe63\uff0d"
#: Invisible characters that are not of category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
#: Where the Unicode database has characters that double another.
BLOCKS = (
    (0x80, 0x3400), (0xA640, 0xABFF), (0xF900, 0x10000), (0x1D400, 0x1D800),
    (0x1EE00, 0x1EF00), (0x1FBF0, 0x1FBFA), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0),
)
_STYLES = ("<font>", "<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")
_WORD_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")


def script_of(char: str) -> str:
    return unicodedata.name(char, "?").partition(" ")[0]


def _single(char: str) -> str | None:
    """What one character becomes; None if it stays."""
    kind = unicodedata.category(char)
    if kind == "Zs" or char == "\t":
        return None if char == " " else " "
    if kind == "Cf" or char in INVISIBLE or "\ufe00" <= char <= "\ufe0f":
        return ""
    if kind == "Cc":
        return None if char in "\n\r\x0b\x0c\x85" else ""
    if char in HYPHENS:
        return "-"
    parts = unicodedata.decomposition(char).split()
    if not parts:
        return None
    plain = unicodedata.normalize("NFKC", char)
    if parts[0] in _STYLES or not parts[0].startswith("<"):
        return plain if plain != char else None
    if parts[0] == "<compat>" and kind in ("Ll", "Lu", "Lt", "Nl") and all(script_of(c) in _WORD_SCRIPTS for c in plain):
        return plain
    return None


def _put(table: dict[str, str], key: str, value: str) -> None:
    if table.setdefault(key, value) != value:
        raise ValueError(f"two forms for {key!r}: {table[key]!r} and {value!r}")


def build_table() -> dict[str, str]:
    """Clusters and their one form. Raises if a cluster has two forms or a
    form would itself be rewritten."""
    table: dict[str, str] = {}
    for char in map(chr, [*range(0x20), 0x7F]):
        if (to := _single(char)) is not None:
            _put(table, char, to)
    for begin, end in BLOCKS:
        for char in map(chr, range(begin, end)):
            if (to := _single(char)) is not None:
                _put(table, char, to)
            elif (apart := unicodedata.normalize("NFD", char)) != char and unicodedata.normalize("NFC", apart) == char:
                _put(table, apart, char)
    for key, value in table.items():
        for part in value:
            if part in table:
                raise ValueError(f"the form of {key!r} is rewritten itself")
    return table


def _lookalikes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    to_latin: dict[str, str] = {}
    from_latin: dict[str, dict[str, str]] = {}
    for script, (foreign, latin) in LOOKALIKES.items():
        for a, b in zip(foreign, latin, strict=True):
            _put(to_latin, a, b)
            from_latin.setdefault(script, {}).setdefault(b, a)
    return to_latin, from_latin


_WORD = re.compile(r"[^\W_]+")
#: Greek, Cyrillic and Armenian, as the inside of a character class.
ABROAD = "\u0370-\u058f\u1f00-\u1fff"
_FOREIGN = re.compile(f"[{ABROAD}]")


class Transducer:
    """The compiled matcher; build it once per process."""

    def __init__(self) -> None:
        self.table = build_table()
        self.to_latin, self.from_latin = _lookalikes()
        self.longest = max(map(len, self.table))
        single = {k for k in self.table if len(k) == 1}
        marks = {k[1] for k in self.table if len(k) > 1} | {chr(c) for c in range(0x300, 0x370)}
        self.suspect = re.compile(f"[^{_char_class(_common(self.table))}]")
        lone = single | marks | set(self.to_latin)
        self.trigger = re.compile(f"[{_char_class(lone)}]|(?<=[A-Za-z])[{ABROAD}]|[{ABROAD}](?=[A-Za-z])")
        # a run: the word around a trigger, with its marks, invisible characters
        # and other forms of letters and digits; a space or a sign is one itself
        self.in_run = {c for c in lone if not (to := self.table.get(c, c)) or to.isalnum() or unicodedata.combining(to[0])}
        self.body = re.compile(f"(?:[^\\W_]|[{_char_class(self.in_run)}])*")
        self.memo: dict[str, str] = {}
        self.scripts: dict[str, str] = {}

    def _clusters(self, run: str) -> str:
        """Longest match first; an accent left over is joined if it can be."""
        out: list[str] = []
        at, end = 0, len(run)
        table = self.table
        while at < end:
            for size in range(min(self.longest, end - at), 0, -1):
                to = table.get(run[at : at + size])
                if to is not None:
                    out.append(to)
                    at += size
                    break
            else:
                out.append(run[at])
                at += 1
        text = "".join(out)
        return unicodedata.normalize("NFC", text) if any("\u0300" <= c <= "\u036f" for c in text) else text

    def _script(self, char: str) -> str:
        found = self.scripts.get(char)
        if found is None:
            found = self.scripts[char] = script_of(char)
        return found

    def _settle(self, word: str) -> str | None:
        """A word with its look-alikes settled; None if the text must decide."""
        scripts = {self._script(c) for c in word if c.isalpha()} & set(_WORD_SCRIPTS)
        foreign = scripts - {"LATIN"}
        if not foreign:
            return word
        sure = {self._script(c) for c in word if c.isalpha() and c not in self.to_latin}
        sure_foreign = (sure & set(_WORD_SCRIPTS)) - {"LATIN"}
        if "LATIN" in scripts:
            known = {b for s in foreign for b in self.from_latin[s]}
            sure_latin = any(self._script(c) == "LATIN" and c not in known for c in word if c.isalpha())
            if not sure_foreign:
                return "".join(self.to_latin.get(c, c) for c in word)
            if sure_latin or len(sure_foreign) > 1:
                return word  # truly of two scripts
            back = self.from_latin[next(iter(sure_foreign))]
            return "".join(back.get(c, c) if self._script(c) == "LATIN" else c for c in word)
        if sure_foreign or len(foreign) > 1 and not all(c in self.to_latin for c in word if c.isalpha()):
            return word
        return None

    def _judge(self, text: str, begin: int, end: int, word: str) -> str:
        """A word of look-alikes only, by the text around it."""
        script = next(self._script(c) for c in word if c.isalpha())
        plain = "".join(self.to_latin.get(c, c) for c in word)

        def sort(piece: str) -> int:
            """1: surely the word's script, -1: surely Latin, 0: can't tell."""
            piece = unicodedata.normalize("NFKC", piece)
            if any(self._script(c) == script and c not in self.to_latin for c in piece):
                return 1
            return -1 if any(self._script(c) == "LATIN" for c in piece) else 0

        first = text.rfind("\n", 0, begin) + 1
        last = text.find("\n", end)
        line_end = len(text) if last < 0 else last
        before = [m for m in _WORD.finditer(text, first, begin)]
        after = [m for m in _WORD.finditer(text, end, line_end)]
        tied = 0
        for words, tight in ((before[::-1], lambda m: m.end() == begin or not re.search(r"\s", text[m.end() : begin])), (after, lambda m: not re.search(r"\s", text[end : m.start()]))):
            for m in words:
                if not tight(m):
                    break
                if verdict := sort(m.group()):
                    tied = tied or verdict
                    break
        if tied:
            return word if tied > 0 else plain
        near = [next((v for m in words[:3] if (v := sort(m.group()))), 0) for words in (before[::-1], after)]
        if 1 in near:
            return word
        if -1 in near:
            return plain
        total = sum(sort(m.group()) for m in _WORD.finditer(text))
        return word if total > 0 or total == 0 and not _latin(text, self) else plain

    def _rewrite(self, whole: str, begin: int, end: int) -> str:
        run = whole[begin:end]
        done = self.memo.get(run)
        if done is not None:
            return done
        text = self._clusters(run)
        if not _FOREIGN.search(text):
            settled, fixed = text, True
        else:
            fixed, pieces, at = True, [], 0
            for m in _WORD.finditer(text):
                word = self._settle(m.group())
                if word is None:
                    fixed = False
                    word = self._judge(whole, begin, end, m.group())
                pieces += [text[at : m.start()], word]
                at = m.end()
            settled = "".join([*pieces, text[at:]])
            if settled != text:  # an accent may join a letter now
                settled = self._clusters(settled)
        if fixed and len(self.memo) < 200_000:
            self.memo[run] = settled
        return settled

    def __call__(self, text: str) -> str:
        """One pass; where letters of other scripts are left beside what
        changed, it is looked at again until nothing changes."""
        new = self._once(text)
        for _ in range(len(text)):  # each turn settles one word at least
            if new == text or not _FOREIGN.search(new):
                break
            text, new = new, self._once(new)
        return new

    def _once(self, text: str) -> str:
        found = self.suspect.search(text) and self.trigger.search(text)
        if found is None:
            return text
        pieces, at = [], 0
        while found:
            begin, end = self._run(text, found.start(), at)
            pieces += [text[at:begin], self._rewrite(text, begin, end)]
            at = end
            found = self.trigger.search(text, at)
        pieces.append(text[at:])
        return "".join(pieces)


    def _run(self, text: str, trigger: int, at: int) -> tuple[int, int]:
        char = text[trigger]
        if not (char in self.in_run or char.isalnum()):
            return trigger, trigger + 1
        begin = trigger
        while begin > at and (text[begin - 1].isalnum() or text[begin - 1] in self.in_run):
            begin -= 1
        return begin, self.body.match(text, trigger + 1).end()

    def aligned(self, text: str) -> tuple[str, list[int], list[int]] | None:
        """The one form with, for each of its characters, where the characters
        it stands for begin and end in ``text``; None if nothing changes."""
        found = self.suspect.search(text) and self.trigger.search(text)
        if found is None:
            return None
        pieces: list[str] = []
        begins: list[int] = []
        ends: list[int] = []
        at = 0

        def keep(begin: int, end: int) -> None:
            begins.extend(range(begin, end))
            ends.extend(range(begin + 1, end + 1))

        while found:
            begin, end = self._run(text, found.start(), at)
            new = self._rewrite(text, begin, end)
            keep(at, begin)
            if len(new) == end - begin:
                keep(begin, end)
            else:
                sources = self._sources(text[begin:end], new)
                begins += [begin + a for a, _ in sources]
                ends += [begin + b for _, b in sources]
            pieces += [text[at:begin], new]
            at = end
            found = self.trigger.search(text, at)
        keep(at, len(text))
        even = "".join([*pieces, text[at:]])
        if even == text:
            return None
        settled = self(even)
        if len(settled) == len(even):  # as always where only look-alikes were left
            return settled, begins, ends
        return settled, *map(list, zip(*_walk(text, settled)))

    def _sources(self, run: str, new: str) -> list[tuple[int, int]]:
        """Where each character of a rewritten run comes from."""
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(run):
            for size in range(min(self.longest, len(run) - at), 0, -1):
                to = self.table.get(run[at : at + size])
                if to is not None:
                    break
            else:
                size, to = 1, run[at]
            out += [(at, at + size)] * len(to)
            at += size
        return out if len(out) == len(new) else _walk(run, new)


def _walk(run: str, new: str) -> list[tuple[int, int]]:
    """Sources where accents were joined that the table doesn't have: an accent
    goes with the character before it."""
    groups: list[list[int]] = []
    for k, c in enumerate(run):
        if groups and unicodedata.combining(c):
            groups[-1][1] = k + 1
        elif unicodedata.category(c) != "Cf":
            groups.append([k, k + 1])
    spans = [(a, b) for a, b in groups][: len(new)]
    return spans + [(len(run), len(run))] * (len(new) - len(spans))


def _latin(text: str, t: Transducer) -> bool:
    return any(t._script(c) == "LATIN" for c in text)


def _common(table: dict[str, str]) -> set[str]:
    """Common characters that are never triggers, in few ranges."""
    points = [*range(0x20, 0x250), *range(0x2013, 0x2027), 0x20AC]
    return {chr(p) for p in points if chr(p) not in table} | {"\n", "\r"}


def _spans(chars: set[str]) -> list[list[int]]:
    spans: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return spans


def _char_class(chars: set[str]) -> str:
    """The inside of a character class for Python."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _spans(chars))


def _java_class(chars: set[str]) -> str:
    """The inside of a character class for Java."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _spans(chars))


_shared: list[Transducer] = []


def transducer() -> Transducer:
    if not _shared:
        _shared.append(Transducer())
    return _shared[0]


def normalise_text(text: str | None) -> str | None:
    """One text in its one form; null stays null."""
    return None if text is None else transducer()(text)


def needs_look(text: Column) -> Column:
    """False for texts of common characters that are never triggers, which so
    never reach Python; few ranges, as Java tries them one by one."""
    return text.rlike(f"[^{_java_class(_common(build_table()))}]")


@F.pandas_udf(StringType())
def _normalise(texts):
    apply = transducer()
    return texts.map(apply, na_action="ignore")


def normalised(text: Column) -> Column:
    """The one form of a string column; null for null."""
    return F.coalesce(_normalise(F.when(needs_look(text), text)), text)


def normalised_fields(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """``chunks.text`` and ``cells.raw_source`` in one form: kind, rec_id, text
    (the new form), changed. Repeated rows count once; null and blank texts
    come out as they are and unchanged; other columns are ignored."""
    parts = [
        chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("rec_id"), F.col("text").alias("was")),
        cells.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("rec_id"), F.col("raw_source").alias("was")),
    ]
    out = parts[0].unionByName(parts[1]).withColumn("text", normalised(F.col("was")))
    return out.select("kind", "rec_id", "text", F.coalesce(~F.col("text").eqNullSafe(F.col("was")), F.lit(False)).alias("changed")).dropDuplicates(["kind", "rec_id"])


def lookalike_records(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """The records that held something to replace or remove: kind, rec_id."""
    parts = [
        chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("rec_id"), F.col("text").alias("was")),
        cells.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("rec_id"), F.col("raw_source").alias("was")),
    ]
    held = parts[0].unionByName(parts[1]).filter(needs_look(F.col("was")))
    return held.withColumn("now", _normalise("was")).filter("now != was").select("kind", "rec_id").distinct()
