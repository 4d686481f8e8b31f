"""People and ways to reach them in free text (problem 6).

Method: a semi-Markov conditional random field. Patterns propose stretches of
text (whole spans) with a type; features of the whole span and of what stands
beside it score each; dynamic programming over spans of bounded length chooses
boundaries and types together, the best set of spans that don't overlap.
Weights are learned by maximum likelihood (forward-backward over the same
lattice) from a bounded sample of labelled lines that ``training_lines`` makes.

Look-alikes and invisible characters are evened out before and places carried
back, so that a stretch is reported exactly as it is written. Every row of two
capitalised words or more is looked at, wherever it stands. What can only be
found by what is written before or in it (a lone name after a title, emails,
persons' numbers, addresses) is looked for around such signs; an automaton finds
them all in one pass.

Where a pattern may end in two ways (a phone number with or without extension, a
street with or without flat, a bare number that may be a phone's or a person's)
both are proposed, and the model chooses.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.arrow import pieces
from tessera.llm.normalise import transducer

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: Labelled lines the model is trained on, and passes over them.
TRAINING_LINES, EPOCHS = 12_000, 8
#: Characters around a trigger that are looked at.
REACH = 60
#: Words a name has at most.
NAME_WORDS = 5

#: Given names known beforehand, by language. Others are found
#: by their surroundings.
GIVEN = tuple(
    """
    Ansel Corrin Della Elodie Fenton Greta Hollis Imogen Jasper Keira Linus Maren Marta Nolan Odette Perrin Rosalind Silas
    Tamsin Tobin Ulric Verity Wendell Yara
    Annika Bernd Björn Cordula Detlef Elke Frauke Gernot Heike Ingo Jürgen Kerstin Lutz Mareike Norbert Ortrun Sören Ulrike
    Amélie Benoît Clémence Didier Élise Fabrice Gaëlle Hervé Inès Joël Léa Maëlle Noémie Océane Régis Solène Théo Zoé
    Aarón Begoña Ciro Débora Efraín Fátima Gonzalo Inés Íñigo Jesús Lucía Máximo Nuria Pilar Rocío Tomás Úrsula Ximena
    Agnieszka Bożena Czesław Dorota Elżbieta Grażyna Jarosław Kinga Łucja Mirosław Paweł Radosław Stanisław Urszula Wiesław
    Zofia
    Αγγελική Βασίλης Γιώργος Δήμητρα Ελένη Ζωή Ηλίας Θανάσης Ιωάννα Κώστας Μαρία Νίκος
    Борис Вера Глеб Дарья Егор Жанна Инна Кирилл Лидия Марина Тимур Юлия
    """.split()
)
#: Words of firms, departments and places.
TRADE = frozenset(
    """
    optics foods textiles shipping office print insurance energy clinic furniture ceramics laboratories instruments
    logistics packaging timber tooling catering freight software inc ltd llp gmbh group company bank
    desk control services care payable payroll procurement treasury compliance facilities records claims customer legal
    warehouse accounts bay cross street road lane avenue
    """.split()
)
#: Words that begin sentences and stand in no name but rarely.
SMALL_WORDS = frozenset(
    """
    the a an this that these those every each no any some all for from in on at by of to with after before under over between and or but if when where while as our
    der die das den dem des ein eine einer kein keine jede jeder im am zum zur für von mit nach vor unter über und oder wenn bei aus
    le la les un une du au aux chaque aucun aucune selon après avant avec pour par dans sur sous où si et ou
    el los las una unos ningún ninguna cada todo según tras antes con para por en sobre bajo y al del
    w z na po za do od dla przez przed każdy żaden jeśli i lub
    """.split()
)
#: Titles before a name, not part of it.
TITLES = frozenset("dr mr ms mrs miss prof herr frau m mme mlle d dña don doña sr sra srta p pan pani г-н г-жа κ κα κος".split())
#: Words that announce a person's number.
ID_CUES = frozenset("aadhaar identity tax ssn pesel passport licence license security id dni nif nie personalausweis pass steuer-id insurance".split())
#: What a lone name stands after, and cues whose surroundings are looked at, in
#: lower case, by what is looked for there.
TITLE_TRIGGERS = tuple(f"{title}{end}" for title in sorted(TITLES) for end in (". ", " ", ".\n", "\n"))
ID_TRIGGERS = ("ssn", "aadhaar", "tax id", "identity card", "id card", "social insurance", "pesel", "passport", "licence ", "license ", "security number", "national id", "dni ", "nif ", "personalausweis", "паспорт", "insurance number", "steuer-id")
ADDRESS_TRIGGERS = ("street", " st.", " st,", " ave", " lane", " road", " rd", " way", "crescent", " close", " court", " drive", " square", " terrace", " boulevard", "straße", "strasse", "gasse ", "allee ", "platz ", " weg ", " rue ", "chemin ", "calle ", "avda", "avenida", "plaza ", "paseo ", "ul. ", "al. ", "os. ", "pl. ")
EMAIL_TRIGGERS = ("@", "(at)", "[at]")

_ABOVE = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
_WORD = rf"[{_ABOVE}][^\W\d_]+(?:['’][^\W\d_]+)?(?:-[{_ABOVE}][^\W\d_]+)*"
_INITIAL = rf"[{_ABOVE}]\."
_RUN = re.compile(rf"(?<![^\W_])(?<![-’'])(?<![^\W_]\.)(?:{_WORD}|{_INITIAL})(?:,?[ \n](?:{_WORD}|{_INITIAL}))*(?![^\W_])")
_PIECE = re.compile(rf"{_WORD}|{_INITIAL}")
_ROW = re.compile(rf"(?<![^\W_])(?<![-’'])(?<![^\W_]\.)(?:{_WORD}|{_INITIAL})(?:,?[ \n](?:{_WORD}|{_INITIAL}))+")
EMAIL = re.compile(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]+)* ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}(?![\w-])", re.IGNORECASE)
_EXTENSION = r"(?:,? ?(?:ext|extension|durchwahl|poste|wew|int|доб)\.? ?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w+])(?<![\d][.,/-])(?<!\d )(?:"
    r"\+\d{1,3}(?:[ ./-]{0,3}\(?\d{1,8}\)?){1,6}"
    r"|\(0?\d{2,4}\)[ -]?\d{3,8}(?:[ -]\d{2,6})*"
    r"|\d{3}(?P<us>[-. ])\d{3}(?P=us)\d{4}"
    r"|0\d(?P<fr>[. ])\d\d(?:(?P=fr)\d\d){3}"
    r"|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,6})?"
    r"|(?P<bare>\d{10})"
    rf")(?P<ext>{_EXTENSION})(?![\w])(?![.,/-]\d)",
    re.IGNORECASE,
)
ID_VALUE = re.compile(
    r"(?<![\w.,/-])(?:\d{3}(?P<s>[- ])\d{2}(?P=s)\d{4}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{11}|[A-Z]{1,2} ?\d{6,8} ?[A-Z]?|[A-Z]{2,5}9{0,3}\d{6}[A-Z0-9]{2,5}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{4} ?\d{6}|\d{4} \d{4} \d{4})(?![\w])(?![.,/-]\d)"
)
_NAME = rf"(?:[{_ABOVE}][\w’'-]+)"
_ROOM = r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)"
_LOWER_TAIL = re.compile(r"(?<=[^\W\d_])(?: [^\W\d_A-Z][\w’'-]*)+$")
_ROOM_AFTER = re.compile(rf",[ \n]{_ROOM}[ \n]\d+\w?$", re.IGNORECASE)
_ROADS = r"(?:Street|St\.|St(?![\w.])|Avenue|Ave\.?|Lane|Ln\.?|Way|Road|Rd\.?|Crescent|Close|Court|Drive|Square|Terrace|Boulevard|Blvd\.?|Hill|Row|Walk|Gardens)"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:"
    rf"(?P<en>(?:{_ROOM}[ \n]\d+\w?,[ \n])?\d{{1,5}}[A-Z]?[ \n](?:(?:{_NAME} ){{1,4}}|(?:{_NAME}[ \n]){{1,3}}?){_ROADS}(?:,[ \n]{_ROOM}[ \n]\d+\w?)?)"
    rf"|(?P<de>(?:[{_ABOVE}][\w-]*(?:stra(?:ß|ss)e|gasse|allee|damm)|{_NAME}(?:[ \n]Weg)|(?:Am|An der|Im|Zum)[ \n][{_ABOVE}][\w-]+)[ \n]\d{{1,4}}[ ]?[a-z]?)"
    rf"|(?P<fr>\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ \n](?:rue|avenue|chemin|boulevard|impasse|allée|place|quai|cours)[ \n](?:(?:de|des|du|d’|de la|de l’|la|le|les)[ \n]?)?{_NAME}(?: {_NAME}){{0,2}})"
    rf"|(?P<es>(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino)[ \n](?:de[ \n])?(?:la[ \n]|los[ \n]|las[ \n]|el[ \n])?{_NAME}(?: {_NAME}){{0,2}},?[ \n]\d{{1,4}}(?:,[ \n]\d{{1,2}}\.?[ºª](?:[ \n][A-Z](?![\w]))?)?)"
    rf"|(?P<pl>(?:ul\.|al\.|os\.|pl\.)[ \n]{_NAME}(?: {_NAME}){{0,2}}[ \n]\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?)"
    rf")(?![\w])(?![.,/-]\d)",
    re.IGNORECASE,
)
_GOES_ON = re.compile(rf"(?:,?[ \n](?:{_WORD}|{_INITIAL}))*")
_BEFORE = re.compile(r"([^\W\d_]+(?:[-’'][^\W\d_]+)*|[|/<(]|[\d])\W*$")
_AFTER = re.compile(r"\s*([^\W\d_]+|[|/<(,;.:)]|\d|$)")
Candidate = tuple[int, int, int, list[str]]


def _left(text: str, begin: int) -> tuple[list[str], bool]:
    """Features of what stands before a place; whether it is a title."""
    head = text[max(0, begin - 40) : begin]
    found = _BEFORE.search(head)
    title = letter = False
    if found and found.group(1).lower() in TITLES and re.fullmatch(r"\.?[ \n]", head[found.end(1) :]):
        title, letter = True, len(found.group(1)) == 1
        head = head[: found.start(1)]
        found = _BEFORE.search(head)
    gap = head[found.end(1) :] if found else head
    word = found.group(1).lower() if found else "^" if begin <= 40 or not head else "?"
    if "\n" in gap:  # a new line begins afresh
        word, gap = "^", ""
    sign = next((c for c in gap if c in ":=.,;|/("), " ")
    out = [f"l={'9' if word.isdigit() else word}", f"ls={sign}", f"lb={'9' if word.isdigit() else word}{sign}"]
    if title:
        out.append("title: letter" if letter else "title")  # a letter may be an initial
    return out, title


def _right(text: str, end: int) -> list[str]:
    found = _AFTER.match(text, end)
    word = found.group(1).lower() if found else "?"
    return [f"r={'9' if word.isdigit() else word or '$'}"]


#: The rest of a number like ``INV-2024`` or of a longer word: no name ends before it.
_CODE_GOES_ON = re.compile(r"[-/]\w|\.\d")
_GIVEN_FOLDED = frozenset(n.casefold() for n in GIVEN)


def _name_candidates(text: str, begin: int, end: int) -> Iterator[Candidate]:
    for run in _RUN.finditer(text, begin, end):
        pieces = [(m.start(), m.end(), m.group()) for m in _PIECE.finditer(text, run.start(), run.end())]
        n = len(pieces)
        known = [p.casefold() in _GIVEN_FOLDED for _, _, p in pieces]
        trade = [any(w in TRADE for w in re.split(r"[-’' ]", p.casefold())) for _, _, p in pieces]
        initial = [p[-1] == "." for _, _, p in pieces]
        comma = [k + 1 < n and "," in text[pieces[k][1] : pieces[k + 1][0]] for k in range(n)]
        broken = [k + 1 < n and "\n" in text[pieces[k][1] : pieces[k + 1][0]] for k in range(n)]
        folded = [p.casefold().rstrip(".") in TITLES for _, _, p in pieces]
        for i in range(n):
            left = None
            for j in range(i, min(n, i + NAME_WORDS)):
                if j > i and trade[j]:
                    break
                if _CODE_GOES_ON.match(text, pieces[j][1]):
                    continue
                words = [k for k in range(i, j + 1) if not initial[k]]
                commas = [k for k in range(i, j) if comma[k]]
                if not words or initial[j] and not commas or len(commas) > 1 or commas and (commas[0] != i or j == i):
                    continue
                if folded[i] and not initial[i] and j > i:
                    break
                if any(broken[i:j]) and not (j == i + 1 and (known[j] if commas else known[i])):
                    continue
                if left is None:
                    left, title = _left(text, pieces[i][0])
                if i == j and not title and not known[i]:
                    continue
                shape = ",".join(("i" if initial[k] else "w") + ("," if comma[k] else "") for k in range(i, j + 1))
                given = known[i + 1] if commas else known[i]
                feats = [f"name:{shape}", *(f"name:{f}" for f in left), *(f"name:{f}" for f in _right(text, pieces[j][1]))]
                if not given and all(pieces[k][2].isupper() for k in words):
                    feats.append("name:capitals")
                feats.append("name:given" if given else "name:initial" if initial[i + 1 if commas else i] else "name:unknown")
                if any(pieces[k][2].casefold() in SMALL_WORDS for k in words):
                    feats.append("name:small word")
                if any(trade[i : j + 1]):
                    feats.append("name:trade")
                if j + 1 < n and not comma[j] and not broken[j]:
                    feats.append("name:trade after" if trade[j + 1] else "name:goes on")
                    if known[j]:
                        feats.append("name:ends with a given name")
                if i and not comma[i - 1] and not broken[i - 1] and not folded[i - 1]:
                    feats.append("name:began before")
                if i and comma[i - 1] and known[i]:
                    feats.append("name:given after comma")
                if any(broken[i:j]):
                    feats.append("name:broken")
                if any(known[k] for k in range(i + 1, j + 1)) and not commas:
                    feats.append("name:given later")
                if initial[i] and len(words) > 1 and not commas:
                    feats.append("name:initial first")
                yield pieces[i][0], pieces[j][1], 4, feats


def _shape(text: str) -> str:
    return re.sub(r"\d+", lambda m: str(len(m.group())), re.sub(r"[^\W\d_]+", "a", text))[:24]


def _near(pattern: re.Pattern, text: str, places: list[tuple[int, int]]) -> Iterator[re.Match]:
    for begin, end in places:
        yield from pattern.finditer(text, begin, end)


def candidates(text: str, where: dict[str, list[tuple[int, int]]] | None = None, phones: list[re.Match] | None = None) -> list[Candidate]:
    """The spans proposed: begin, end, type, features. ``where`` tells in which
    stretches to look for names, emails, numbers and addresses; without it the
    whole text is searched for all."""
    whole = [(0, len(text))]
    where = where if where is not None else dict.fromkeys(("name", "id", "address", "email"), whole)
    out: list[Candidate] = []
    for m in _near(EMAIL, text, where["email"]):
        out.append((m.start(), m.end(), 0, ["email", "email:@" if "@" in m.group() else "email:at"]))
    for m in PHONE.finditer(text) if phones is None else phones:
        form = "bare" if m.group("bare") else f"{m.group()[0] if m.group()[0] in '+(0' else '9'}{m.group('us') or m.group('fr') or ''}"
        feats = ["phone", f"phone:{form}", *(f"phone:{form and 'bare ' if form == 'bare' else ''}{f}" for f in _left(text, m.start())[0])]
        if m.group("ext"):
            out.append((m.start(), m.start("ext"), 1, [*feats, "phone:extension left out"]))
            feats = [*feats, "phone:extension"]
        out.append((m.start(), m.end(), 1, feats))
    for m in _near(ID_VALUE, text, where["id"]):
        before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text[max(0, m.start() - 32) : m.start()].lower())[-3:]
        cue = "cue" if ID_CUES & set(before) else "none"
        out.append((m.start(), m.end(), 2, ["id", f"id:{cue}", f"id:l={before[-1] if before else '^'}"]))
    for m in _near(ADDRESS, text, where["address"]):
        feats = ["address", f"address:{m.lastgroup}"]
        small = re.search(r"\b(?:on|of|in|the|to|and|for|mit|und|from|at|by)\b", m.group(), re.IGNORECASE)
        feats.append("address:small words" if small and m.lastgroup != "fr" else "address:plain")
        feats += [f"address:{f}" for f in _left(text, m.start())[0][:2]]
        if m.group()[0].isalpha() and m.group()[0].islower() and m.lastgroup in ("en", "de", "es"):
            feats.append("address:lower case")
        tail = _LOWER_TAIL.search(m.group())
        if tail and not m.group().islower():
            out.append((m.start(), m.start() + tail.start(), 3, [*feats, "address:tail left out"]))
            feats = [*feats, "address:lower tail"]
        if room := _ROOM_AFTER.search(m.group()):
            out.append((m.start(), m.start() + room.start(), 3, [*feats, "address:room left out"]))
        out.append((m.start(), m.end(), 3, feats))
    for begin, end in where["name"]:
        out += _name_candidates(text, begin, end)
    return out


class Model:
    """Weights of the features, and the two dynamic programmes."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def score(self, feats: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in feats)

    def best(self, spans: list[Candidate]) -> list[Candidate]:
        """The best set of spans that don't overlap."""
        scored = sorted(((c[1], c[0], s, c) for c in spans if (s := self.score(c[3])) > 0), key=lambda x: x[:3])
        best, chosen, ends = [0.0], [None], [-1]
        for end, begin, s, c in scored:
            k = len(ends) - 1
            while ends[k] > begin:
                k -= 1
            if best[k] + s > best[-1]:
                best.append(best[k] + s)
                chosen.append((c, k))
                ends.append(end)
        out, k = [], len(chosen) - 1
        while k > 0:
            c, k = chosen[k]
            out.append(c)
        return out[::-1]

    def expected(self, spans: list[Candidate]) -> list[float]:
        """The probability of each span, by forward and backward sums over the
        lattice of all sets of spans that don't overlap."""
        places = sorted({0} | {c[0] for c in spans} | {c[1] for c in spans})
        at = {p: k for k, p in enumerate(places)}
        scores = [self.score(c[3]) for c in spans]
        into: list[list[int]] = [[] for _ in places]
        out: list[list[int]] = [[] for _ in places]
        for k, c in enumerate(spans):
            into[at[c[1]]].append(k)
            out[at[c[0]]].append(k)

        def total(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        ahead = [0.0] * len(places)
        for p in range(1, len(places)):
            ahead[p] = total([ahead[p - 1], *(ahead[at[spans[k][0]]] + scores[k] for k in into[p])])
        back = [0.0] * len(places)
        for p in range(len(places) - 2, -1, -1):
            back[p] = total([back[p + 1], *(back[at[spans[k][1]]] + scores[k] for k in out[p])])
        return [math.exp(ahead[at[c[0]]] + s + back[at[c[1]]] - ahead[-1]) for c, s in zip(spans, scores)]

    def learn(self, lines: list[tuple[str, set[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.4, shrink: float = 1e-4, seed: int = 7) -> "Model":
        """Stochastic ascent of the likelihood of the labelled spans."""
        made = [(candidates(text), gold) for text, gold in lines]
        order = random.Random(seed)
        weights = self.weights
        for epoch in range(epochs):
            order.shuffle(made)
            step = rate / (1 + epoch)
            for spans, gold in made:
                if not spans:
                    continue
                for c, p in zip(spans, self.expected(spans)):
                    gap = (1.0 if c[:3] in gold else 0.0) - p
                    if abs(gap) > 1e-3:
                        for f in c[3]:
                            w = weights.get(f, 0.0)
                            weights[f] = w + step * (gap - shrink * w)
        return self


def _made_word(order: random.Random, parts: int = 2) -> str:
    heads = "bal ber cor dan del fal gar hol jor kal lan mar nor pel quen ras sel tor ul var wes yel zan".split()
    tails = "aker bury dal ette field gan holm ides kin lund moor nik olan quist ren strom thal vick wen zar".split()
    return "".join([order.choice(heads)] * (parts > 2) + [order.choice(heads), order.choice(tails)]).capitalize()


def _person(order: random.Random, title: bool = True) -> tuple[str, str]:
    """A title or nothing, and a name."""
    given = order.choice(GIVEN) if order.random() < 0.75 else _made_word(order)
    last = _made_word(order) + (f"-{_made_word(order)}" if order.random() < 0.15 else "")
    form = order.random()
    if form < 0.6:
        name = f"{given} {last}"
    elif form < 0.75:
        name = f"{given} {order.choice('ABDEGKLMRST')}. {last}"
    elif form < 0.87:
        name = f"{order.choice('ABDEGKLMRST')}. {last}"
    else:
        return "", f"{last}, {given}"
    if order.random() < 0.12:
        name = name.upper()
    if order.random() < 0.03:
        name = name.replace(" ", "\n", 1)
    return (order.choice(["Dr. ", "Mr. ", "Ms. ", "Prof. ", "Herr ", "Frau ", "M. ", "Mme ", "D. ", "Sra. ", "p. "]) if title and order.random() < 0.3 else ""), name


def _digits(order: random.Random, mask: str) -> str:
    return "".join(str(order.randrange(10)) if c == "9" else order.choice("BCDGKLMNPRSTXYZ") if c == "§" else c for c in mask)


#: How numbers and addresses of the training lines are written.
PHONE_MASKS = ("999-555-0199", "(999) 555-0199", "999.555.0199 ext. 999", "+1 999 555 0199", "020 7946 0999", "+44 20 7946 0999", "01632 960999", "+49 30 23125999", "(030) 23125999", "030 23125 999", "+49 (0)30 / 23125-999", "01 99 00 99 99", "06.39.98.99.99", "+33 1 99 00 99 99", "0639 989999", "+48 22 555 99 99", "+34 919 999 999")
ID_MASKS = (("SSN ", "999-99-9999"), ("social security number ", "999 99 9999"), ("national ID ", "99.99.99-999.99"), ("PESEL ", "99999999999"), ("passport no. ", "§§9999999"), ("driving licence ", "§§§§999999§9§§"), ("Aadhaar ", "9999 9999 9999"), ("tax ID ", "99999999999"))
GOODS_MASKS = ("lot 999-99-9999", "lot 999 99 9999", "file 99.99.99/99", "meter 99999999999", "meter 9999 999 9999", "no. 99999", "PO 9999/99", "INV-2029-9999", "CN9999999", "SLA9999999", "§§-999999", "file 99.99.99-999.99", "DN9999999", "RMA9999999")
ADDRESS_MASKS = ("99 # Street", "999 # Ave", "99B # Lane", "Flat 9, 99 # Way", "99 # Road, Unit 99", "9 # St.", "99 # Old Crescent", "#straße 99", "#er Weg 99a", "Am #platz 99", "99, rue des #s", "99 bis, avenue de #", "99 chemin du #", "Calle #, 99", "Avda. de # 99, 3.º B", "Plaza # 99", "ul. #owa 99/9", "al. #owska 99", "os. #owe 9")
#: The training lines. {N} is a name with its title, {F} a firm,
#: {K} a department, {P} a place, {E} an email, {H} a phone number, {I} a
#: person's number with its announcement, {A} an address, {G} a number of goods,
#: {T} ten digits, {L} a lone name, {v} a verb, {f} a small word that begins a sentence, {n} a line break.
VERBS = (
    "said asked told wrote called signed sent met joined left returned drove paid bought sold agreed declined answered accepted refused wants wanted had has was is will would can "
    "could may must works worked lives lived moved runs led leads manages owns keeps took gave made spoke thinks says knows starts started repaired opened closed checked showed brought"
).split()
LINES = tuple(
    """
    Contact: {N}|Contact{s}{N}|Attn{s}{N}|Attn: {N}|Dear {N},|It was {N} who asked {F} to stop the invoice.|{N} approved the final {w} on 3 May 2024.
    {N} ({I}) left {K} on 2024-01-05.|Employee {N} ({I}) left {K} on 2024-01-05.|Holder {N}, {I}, lives at {A}.|Our driver noted {I} for {N} at the gate.
    Please call {N} on {H} about the {w}.|Contact: {N} / {H}|{N} ¦ {H} ¦ {E}|{N} ¦ {H} ¦ {E}|{N} ¦ {H} ¦ {E}|Witness: {N}, {A}|cc: {N}, {E}|For questions write to {E}, attn: {N}.
    The parcel goes to {A}, {P}; ask for {N}.|The late {w} was handed to {N} in {P}.|As {N} told {F} on 3 May 2024, the {w} stays final.|Signed for {F}: {N}
    z. Hd.: {N}|z. Hd.{s}{N}|Ansprechpartner: {N}, Tel. {H}|Gezeichnet {N} für {F}|{N} ({I}) bestätigte die Frist am 2024-01-05.
    À l’attention de: {N}|À l’attention de{s}{N}|Interlocuteur : {N}, tél. {H}|Signé par {N} pour {F}|{N} ({I}) a reçu la facture.
    Atención: {N}|Atención{s}{N}|Persona de contacto: {N}, tel. {H}|Firmado por {N} en nombre de {F}|{N} ({I}) recibió la factura.
    Do rąk: {N}|Do rąk{s}{N}|Osoba do kontaktu: {N}, tel. {H}|Podpisano: {N}, {F}|{N} ({I}) odebrał przesyłkę.
    Контактное лицо: {N}, тел. {H}|Подписал {N} за {F}|Υπεύθυνος: {N}, τηλ. {H}|Υπογραφή: {N}, {F}
    Phone: {H}|Tel{s}{H}|Telefon{s}{H}|Teléfono: {H}|Fax and phone: {H}|Email: {E}|E-Mail{s}{E}|Reach the desk at {E} or {H}.|Replies by 3 May 2024 to {E}.
    Applicant's {I}, checked 3 May 2024.|Address: {A}|Address{s}{A}|Deliver to: {A}|Remit to {F}, {A}, {P}|Anschrift: {A}|Adresse : {A}, {P}|Dirección: {A}|Adres: {A}
    {N}|{N}|{N}|{N} <{E}>|{N} ({K}), {H}|{E}|{K}|{F}|{K}|{F}|{P}|Contact: {K}|Attn: {F}|Vendor: {F}|From{s}{F}|Bill To: {F}|{F} bills {F} for {G}.
    Seal {G} intact, 12 of 40 pallets scanned.|The auditor matched {G} with the {w}.|{K} asked {F} for a final {w} covering {G}.|Your order: {G}
    Since 28.04.2025 the {w} has moved through {P}, {P} and {P}.|{G}, {G}, {G}|{F} and {F} share the {w} at 12 to 40.|120 ordered, 95 sent, 12 on the way to {P}.
    Freight to {P} adds 12.00 PLN, handling 3,50 €.|tempered tool chest ¦ 12 ¦ 438 655 12.00|Interest to 12.08.2019: EUR 111.20|Insurer {F} values the {w}.|No {w} reached {K} before 12/08/2025.
    Die Lieferung ersetzt die Frist mit Größe 12 und Straße {P}.|Candidate led the {w} team at {F} until 2024-01-05.|ON THE WAY TO {P}, {G}|12 PALLETS ON THE WAY TO {P}|Dear Customer Care,|As the {w} is final, {K} holds back 12.00 for {G}.
    In {P} lagern 12 Kartons für die {w}.|The {P} branch forwards each {w} to {K} within 12 days.|After the {w} in {P}, 12 of 40 boxes were still final.|12 parcels left {P} on 3 May 2024.
    À {P}, 12 palettes attendent la {w}.|W mieście {P} czeka 12 paczek.|На складе {P} осталось 12 коробок.|Στην πόλη {P} υπάρχουν 12 κιβώτια.|También {F} pidió un {w}.|Storage in {P} costs 12.00 per {w}.
    Temperature in {P} stayed near 12 °C.|Quedan 12 cajas en {P} según la {w}.|3 May 2024 {P}: taxi 12.00, meals 12.00, {w} 12.00.|Freight to {P} adds 12.00.|Фирма {F} перечислила 12.00 до 3 May 2024.|Spółka {F} opłaciła 12.00.
    Diploma in {w} studies, {P}, 3 May 2024.|Rent of 12.00 for the unit in {P} falls due on day 12.|{F} grants {F} a final {w} over the premises in {P}.|Supply 12 x steel bracket to {P} by 3 May 2024.|clerk for the final {w} desk, {F}, {P}.
    {P} 12.00|{K} scanned 12 pages.|Si el {w} llega a {P}, {F} paga.|Η εταιρεία {F} πλήρωσε 12.00.|Le {w} du 3 May 2024 concerne 12 colis expédiés à {P}.|Insured by {F} in {P}|Status: FINAL|{P}, {P} and {P} share the {w}.|Total Due: 12.00|Invoice Number: {G}
    AN EXTRA MODULAR TOOL CHEST WAS ADDED TO {G} AT 12.00|INSULATED TOOL CHEST ¦ 12 ¦ 12.00|RENT OF 12.00 FOR THE UNIT IN THE TOWN FALLS DUE|SHIP MATTE TOOL CHEST WITH FOLDING STEEL BRACKET|NO FINAL INVOICE REACHED THE DESK BEFORE 12.08.2025
    This {w} was written by {N}.|Please forward the {w} to {N} before noon.|Prepared by {N} and {N}|The {w} was checked by {F}.|Send the {w} to {K}.|Sent to {P} by {F}.|Sold by {F}, {P}|We spoke with {N} about it.|{N} will attend the {w}.|{N}, who joined in May, runs {K}.
    My name is {N} and I live at {A}.|Regards,{n}{N}|Kind regards,{n}{N}{n}{K}|Thanks to {N} for the {w}.|According to {N}, {F} is late.|The {w} went from {P} to {P}.|On behalf of {F}, {N}|Both {N} and {N} agreed.|{F} hired {N} in {P}.|Our colleague {N} is away.
    The {w} went to {P} {f} {w} rose by 12.|It was booked by {K} {f} {w} is final.|Costs are borne by {F}. {f} {G} see the {w}.|{f} {P} lagern 12 Kartons.|Le {w} de {P} {f} {w} reste.|El {w} de {P} {f} {w} suma 12.|12 km to {P} at 12.00 a trip.|{w} at the {P} dock on 3 May 2024.|Two lots from {P} and {P} arrived.
    {N} {v} the {w}.|{N} {v} it in May.|Yesterday {N} {v} the {w}.|We heard that {N} {v} early.|Later {N} {v} the {w} again.|Her brother, {N}, {v} it.|Mr. {L} {v} the {w}.|Dr. {L} {v} it.|It came from {N}, not from {F}.|Nobody except {N} {v} it.|We thank {N}!|Find out whether {N} {v} it.|The {w} is kept by {N} and {N}.
    The {w} names {N} as the owner.|It was made for {N} on Monday.|Two copies go to {N} and {N}.|The {w} with {N} {v} well.|The {w} in {P} {v} the {w}.|{F} {v} the {w}.|{K} {v} the {w}.|The {P} {w} {v} late.|The {w} by {F} {v} the {w}.|Goods for {P} and {P} {v} late.
    Due Date: 3 May 2024|Invoice Date{s}3 May 2024|TOTAL DUE 12.00|Total Due{s}12.00|Invoice Number{s}{G}|INVOICE NUMBER: {G}|Order Date 3 May 2024|Amount Payable: 12.00|Purchase Order {G}|Unit Price{s}12.00|Delivery Note {G}|Tax Number{s}{G}|Terms: Net Thirty|Page Number 12|Through {P}, {P}-le-Lac and {P}|{P}, {P}
    Livré au {A} hier soir.|On loge au {A} jusqu’en juin.|À {A} demain matin.
    Call {H} or {H}.|Call {T} today.|Mobile {T}|call {T}|Text us at {T}|phone {T}|Tracking {T}|Ref {T}|Order {T}|Invoice {T}|Account {T}|Barcode {T}|Batch {T} passed.|Your reference {T}|{w} {T}|Dial {H} for {N}.|Her {I} is on file.|{N} holds {I}.
    From {P} to {P} on 3 May 2024|{P} {P} {w}|The {P} {w} of {F}|Under the {w} with {F}, {K} pays.|Visit {F} at {A}.|{N} moved to {A} last year.|Shipped with {F} via {P}.|Project {P} ends soon.|The {w} for {P} was made by {K}.|Model {P} {P} in stock|Section Two, Table Four|Terms And Conditions|Monthly Report For May
    {N} ({I}) bestätigte die Frist am December 9, 2024.|{N} ({I}) bestätigte die Frist am August 12, 2025.
    """.replace("\n", "|").split("|")
)


def training_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Labelled lines, made from patterns: a text and its spans (begin, end, type)."""
    order = random.Random(seed)
    patterns = [p.strip() for p in LINES if p.strip()]
    firms = [f"{a} {b}" for a in ("Optics", "Foods", "Textiles", "Shipping", "Laboratories", "Energy", "Freight", "Print") for b in ("Ltd", "GmbH", "S.A.", "Inc.", "Group", "& Co.", "Sp. z o.o.", "")]
    desks = ("Accounts Payable", "Claims Desk", "Records Office", "Customer Care", "Legal Services", "Warehouse Control", "Payroll", "Treasury")
    out = []
    for k in range(n):
        pattern = patterns[k % len(patterns)]
        text, gold = "", set()

        def put(value: str, kind: int | None = None) -> None:
            nonlocal text
            if kind is not None:
                gold.add((len(text), len(text) + len(value), kind))
            text += value

        for piece in re.split(r"(\{\w\})", pattern.replace("¦", "|")):
            match piece:
                case "{N}":
                    title, name = _person(order)
                    put(title)
                    put(name, 4)
                case "{E}":
                    at = order.choice(["@", "@", "@", " @ ", " (at) ", " [at] "])
                    host = f"{_made_word(order).lower()}.example" if at != " [at] " else f"{_made_word(order).lower()} [dot] example"
                    mail = f"{order.choice(GIVEN[:24]).lower()}{order.choice(['.smith', '+po', '_k12', ''])}{at}{host}"
                    put(mail.upper() if order.random() < 0.1 else mail, 0)
                case "{H}":
                    put(_digits(order, order.choice(PHONE_MASKS)), 1)
                case "{I}":
                    cue, mask = order.choice(ID_MASKS)
                    put(cue)
                    put(_digits(order, mask), 2)
                case "{A}":
                    street = _digits(order, order.choice(ADDRESS_MASKS)).replace("#", _made_word(order))
                    put(street.upper() if order.random() < 0.08 else street, 3)
                case "{G}":
                    put(_digits(order, order.choice(GOODS_MASKS)))
                case "{F}":
                    put(f"{_made_word(order, 3)} {order.choice(firms)}".strip())
                case "{K}":
                    put(order.choice(desks))
                case "{P}":
                    put(order.choice([_made_word(order), f"{_made_word(order)} Bay", f"Sankt {_made_word(order)}", f"{_made_word(order)} Cross", f"{_made_word(order)} {_made_word(order)}"]))
                case "{w}":
                    put(order.choice("invoice schedule audit delivery tariff premium".split()))
                case "{v}":
                    put(order.choice(VERBS))
                case "{L}":
                    put(_made_word(order), 4)
                case "{f}":
                    put(order.choice(("The", "For", "In", "After", "Every", "La", "Le", "El", "Selon", "Ningún", "Under", "No", "An", "Die", "Im", "W")))
                case "{n}":
                    put("\n")
                case "{T}":
                    said = re.search(r"(?i)\b(?:call|mobile|text us at|phone)\s*$", text)
                    put(_digits(order, "9999999999"), 1 if said else None)
                case "{s}":
                    put(order.choice([" = ", "    ", " ..... ", ": "]))
                case _:
                    put(piece)
        if order.random() < 0.3:
            put(order.choice(["\nVendor: ", "\nTotal: 12.00\n", "\n"]) + f"{_made_word(order, 3)} {order.choice(firms)}")
        out.append((text, gold))
    return out


@lru_cache(maxsize=2)
def trained_model(n: int = TRAINING_LINES, seed: int = 11) -> Model:
    return Model().learn(training_lines(n, seed))


class Finder:
    """Finds the spans of a text with a trained model."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.triggers = ahocorasick.Automaton()
        for kind, cues in (("name", TITLE_TRIGGERS), ("id", ID_TRIGGERS), ("address", ADDRESS_TRIGGERS), ("email", EMAIL_TRIGGERS)):
            for cue in cues:
                self.triggers.add_word(cue, (len(cue), kind))
        for name in GIVEN:
            self.triggers.add_word(name.lower(), (len(name), "given"))
        self.triggers.make_automaton()

    def _places(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], list[re.Match]]:
        """Where to look for what, and the numbers written like phone numbers."""
        low = text.lower()
        size = len(text)
        if len(low) != size:
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        where: dict[str, list[list[int]]] = {"name": [], "id": [], "address": [], "email": []}

        def add(kind: str, begin: int, end: int) -> None:
            begin, end, spans = max(0, begin), min(size, end), where[kind]
            if spans and begin <= spans[-1][1]:
                spans[-1][0] = min(spans[-1][0], begin)
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])

        for last, (length, kind) in self.triggers.iter(low):
            begin, end = last - length + 1, last + 1
            if kind == "given":
                if not (begin and low[begin - 1].isalpha() or end < size and low[end].isalpha()):
                    add("name", begin - 50, end + 50)
            elif kind == "name":
                if not (begin and low[begin - 1].isalpha()):
                    add("name", begin, end + REACH)
            elif kind == "id":
                add("id", begin, end + 40)
            else:
                add(kind, begin - 70, end + 70)
        phones = list(PHONE.finditer(text))
        where["name"] += [[m.start(), m.end()] for m in _ROW.finditer(text)]
        for spans in where.values():
            for span in spans:  # a stretch doesn't begin or end within a word
                while span[0] and not text[span[0] - 1].isspace():
                    span[0] -= 1
                while span[1] < size and not text[span[1]].isspace():
                    span[1] += 1
        for span in where["name"]:  # nor within a row of capitalised words
            span[1] = _GOES_ON.match(text, span[1]).end()
            while span[0] and text[span[0]].isupper():
                before = text.rfind(" ", 0, span[0] - 1) + 1
                if span[0] - before > 40 or not text[before].isupper():
                    break
                span[0] = before
        return {k: _merged(v) for k, v in where.items()}, phones

    def even_spans(self, text: str) -> list[tuple[int, int, int]]:
        where, phones = self._places(text)
        if not phones and not any(where.values()):
            return []
        return [c[:3] for c in self.model.best(candidates(text, where, phones))]

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(begin, end, type) of each stretch, in order."""
        if not text:
            return []
        aligned = transducer().aligned(text)
        if aligned is None:
            return [(a, b, TYPES[t]) for a, b, t in self.even_spans(text)]
        even, begins, ends = aligned
        return [(begins[a], ends[b - 1], TYPES[t]) for a, b, t in self.even_spans(even)]


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


_finders: dict[int, Finder] = {}


def _finder(weights: dict[str, float]) -> Finder:
    key = hash(frozenset(weights.items()))
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(Model(weights))
    return _finders[key]


def _texts(chunks: DataFrame, cells: DataFrame, uploads: DataFrame) -> DataFrame:
    sources = (("chunk", chunks, "chunk_id", "text"), ("cell", cells, "cell_id", "raw_source"), ("upload", uploads, "upload_id", "owner"))
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("text")) for kind, df, key, text in sources]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def find_pii(chunks: DataFrame, cells: DataFrame, uploads: DataFrame, model: Model | None = None) -> DataFrame:
    """kind, rec_id, pii_type, pii_text: each distinct stretch of each record,
    exactly as written. Null, empty and blank texts have none; repeated rows
    count once; other columns are ignored; empty tables give no rows."""
    spark = chunks.sparkSession
    weights = spark.sparkContext.broadcast((model or trained_model()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights.value)
        for batch in pieces(batches):
            owners, types, texts = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for a, b, kind in find(text):
                    owners.append(k)
                    types.append(kind)
                    texts.append(text[a:b])
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(types, pa.string()), pa.array(texts, pa.string())], names=["kind", "rec_id", "pii_type", "pii_text"])

    rows = _texts(chunks, cells, uploads).filter(F.length("text") > 3)
    return rows.mapInArrow(run, "kind string, rec_id bigint, pii_type string, pii_text string").distinct()


def redact_text(text: str | None, find: Finder) -> str | None:
    """The text with a placeholder like ``[EMAIL]`` for each stretch."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(chunks: DataFrame, cells: DataFrame, uploads: DataFrame, model: Model | None = None) -> DataFrame:
    """kind, rec_id, text with placeholders; all else unchanged. Null stays
    null; repeated rows count once."""
    spark = chunks.sparkSession
    weights = spark.sparkContext.broadcast((model or trained_model()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights.value)
        for batch in pieces(batches):
            texts = [redact_text(t, find) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["kind", "rec_id", "text"])

    return _texts(chunks, cells, uploads).mapInArrow(run, "kind string, rec_id bigint, text string").dropDuplicates(["kind", "rec_id"])
