"""Personal information inside free text (problem 8)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from skein.llm.disguise import Plain

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# ---------------------------------------------------------------- e-mail

_DOMAIN = re.compile(r"(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}(?![A-Za-z0-9_])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at > 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > 0 and (text[start - 1].isalnum() and (text[start - 1].isascii() or not _CJK.match(text[start - 1])) or text[start - 1] in "._+%'-"):
                start -= 1
            while start < at and text[start] in ".'+%-":
                start += 1
            if start < at:
                yield start, domain.end()
                at = domain.end() - 1
        at = text.find("@", at + 1)


# ---------------------------------------------------------------- numbers

#: Six digits or more with short gaps.
_RUN = re.compile(r"\d(?:[ ().\-/\n]{0,3}\d){4,}")
_BEFORE = re.compile(r"(?:\+ ?\(?|\(\+?|[A-Z]{1,2} ?)$")
_AFTER = re.compile(r"[Xx](?![^\W_])|-[A-Z]{1,2}\d{0,2}(?!\w)| ?[A-Z](?!\w)")
_DIGITS = re.compile(r"\D+")

# Shapes of personal numbers (national, tax, social security, passport).
_ID_SHAPES = re.compile(
    r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{17}[\dXx]|\d{8}-[A-Z]{2}\d{2}|\d{8}-[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{1,2}\d{7}|\d{3} \d{2} \d{4}"
)
# Shapes of telephone numbers, written with or without a prefix.
_PHONE_SHAPES = re.compile(
    r"\+ ?\d{1,3}[ ().\-/\d]{6,22}\d|00\d{2,3} ?[ ().\-/\d]{6,22}\d|\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,5}|0\d(?: \d\d){4}|0\d{2,4}[/-]\d{4,6}(?:[ -]\d{2,4})?|\d{3}[.\-]\d{3}[.\-]\d{4}|1[2-9]\d{9}|555-\d{4}"
)
# Words before a number that tell what it is.
_ID_CUE = re.compile(
    r"(?:\bID|[Pp]assport|(?:social security|national identity|tax|identity|insurance|personal) (?:number|code|no\.?)|[Ss]teuernummer|[Pp]ersonenkennzahl|[Pp]ersonalausweis|[Aa]usweis|[Ss]ozialversicherungsnummer"
    r"|(?:numéro|nº|número|n°) (?:fiscal|de sécurité sociale|d'identité|de identidad)|[Dd]ocumento|\bDNI|\bNIE|\bNIF|[Pp]asaporte|[Pp]asseport|身份证号?|证件号|护照号?|税号|个人番号|個人番号|(?<!電話)(?<!登録)(?<!出願)番号|マイナンバー|旅券番号|SSN|NINO|PESEL|CPF|[Tt]ax ID|TIN|[Cc]odice fiscale|[Ii]nventor)\W{0,4}(?:(?:des|of|du|del|der) \w+\W{0,3})?$"
)
_PHONE_CUE = re.compile(
    r"(?:\b[Tt]el|\b[Tt]él|\bTEL|[Tt]elefono|[Tt]eléfono|[Tt]elefon|[Tt]éléphone|[Tt]elephone|[Pp]hone|[Ff]ax|FAX|[Mm]obil\w*|\b[Cc]all|[Rr]each us|\b[Dd]ial|\bunder|\bunter|\bsous|\bbajo|电话|電話|電話番号|手机|携帯)\W{0,4}$"
)
_OTHER_CUE = re.compile(
    r"(?:\btype|\bTyp|\bbatch|\bmodel code|\bcode|\bstandard(?: [A-Z]{2})?|registry number|application No\.?|\bNo\.?|\bNr\.?|measures|\breached|document(?: [A-Z]{2})?|\bserial|\bpart number|\bRegistry|\bversion|\border|\bCAS|marked|\bdocket|claims?|Fig\.|\bEq\.)\W{0,3}$"
)
_UNIT = re.compile(r"\s?(?:mm|cm|µm|nm|km|kPa|MPa|Pa|Hz|kHz|MHz|°C|kg|mg|ml|min|cycles|wt|%|percent)(?![^\W_])")


def checked_digits(number: str) -> bool:
    """Whether a number of 18 signs holds a date and the check sign of a Chinese citizen's number."""
    if len(number) != 18 or not number[:17].isdigit():
        return False
    month, day = int(number[10:12]), int(number[12:14])
    if number[6:8] not in ("18", "19", "20") or not 1 <= month <= 12 or not 1 <= day <= 31:
        return False
    # weights are the powers of two modulo 11
    total = sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(number[:17]))
    return (12 - total) % 11 == (10 if number[17] in "Xx" else int(number[17]))


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    while m := _RUN.search(text, at):
        start, end = m.span()
        at = end
        if start and (text[start - 1] in ".,/@-_" and text[start - 2 : start - 1].isalnum()):
            continue
        run = m.group()
        # a new line or sentence within the run begins another number
        for stop in ("\n", ". ", " ("):
            cut = run.find(stop, 6)
            if cut > 0 and len(_DIGITS.sub("", run[:cut])) >= 7:
                run = run[:cut]
                at = end = start + cut
        tail = _AFTER.match(text, end)
        far = tail.end() if tail else end
        lead = _BEFORE.search(text, max(0, start - 3), start)
        found = None
        if lead and not (lead.group()[0].isalpha() and text[lead.start() - 1 : lead.start()].isalnum()):
            found = _number(text, lead.start(), end, far)
        found = found or _number(text, start, end, far)
        if found:
            yield found
            at = max(at, found[1])


def _number(text: str, start: int, end: int, far: int) -> tuple[int, int, str] | None:
    """The number from ``start``; its digits end at ``end``, letters that may belong to it at ``far``."""
    before = text[max(0, start - 40) : start]
    if _OTHER_CUE.search(before):
        return None
    flat = text[start:far].replace("\n", " ")
    digits = _DIGITS.sub("", text[start:end])
    phone_cue = _PHONE_CUE.search(before)
    id_cue = not phone_cue and _ID_CUE.search(before)
    if not phone_cue:
        m = _ID_SHAPES.match(flat)
        if m and m.end() >= end - start:
            shape = m.group()
            loose = shape.isdigit() or re.fullmatch(r"\d{2} \d{3} \d{3} \d{3}|\d{3} \d{2} \d{4}", shape)
            if id_cue or not loose or checked_digits(shape):
                return start, start + m.end(), ID_NUMBER
        if id_cue and len(digits) >= 6 and flat[0] not in "+(":
            return start, end, ID_NUMBER
    if text[start] == "(" and text.find(")", start, end) < 0 or text[start].isalpha() or _UNIT.match(text, end):
        return None
    flat = text[start:end].replace("\n", " ")
    bare = re.fullmatch(r"\d{3}-\d{3}-\d{4}", flat)
    if 7 <= len(digits) <= 15 and (phone_cue or (not bare and _PHONE_SHAPES.fullmatch(flat))):
        return start, end, PHONE
    return None


# ---------------------------------------------------------------- addresses

_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’]*(?:-[\w'’]+)*"
_TOWN = rf"{_CAP}(?: {_CAP})?"
_CODE = r"(?:(?:[A-Z]{1,2}-)?\d{4,6}|\d{2}-\d{3})"
# Fixed value: shape of British postal codes.
_BRITISH = r"[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}(?!\w)"
_STEP = r"(?:, |,\n|\n)"
_TAIL = rf"(?:{_STEP}{_TOWN}(?:,? |,?\n){_BRITISH}|{_STEP}{_TOWN}, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?(?!\d)|(?:{_STEP}| ){_CODE} {_TOWN}|{_STEP}{_TOWN} {_CODE}(?!\d)|, {_TOWN}|\n{_TOWN}(?=[.,;])|(?:{_STEP}| ){_CODE}(?!\d))?"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \w+"
_ROAD = r"(?:Street|St\.|St|Lane|Ln\.?|Road|Rd\.?|Avenue|Ave\.?|Terrace|Way|Drive|Court|Place|Close|Row|Square|Hill|Boulevard|Blvd\.?|Crescent|Gardens|Grove|Mews|Parade|Walk)(?!\w)"
_VIA = rf"(?:Via|Viale|Piazza|Corso|Largo|Vicolo)(?: del(?:la|lo)?| dei| degli| di)? {_CAP}(?: {_CAP})?"
_STREET = [
    rf"(?:{_FLAT}, )?\d{{1,5}} ?[A-Z]? (?:{_CAP} ){{1,3}}{_ROAD}(?:, {_FLAT}|, #\w+)?",
    r"(?:P\. ?O\. ?Box|PO Box|Post Office Box|Box|Postfach|Apartado(?: de Correos)?|Boîte postale|B\.?P\.?) \d{2,6}",
    rf"(?:{_CAP}(?:str\.|straße|strasse|weg|platz|gasse|allee|ring|ufer|damm)|{_CAP}er (?:Weg|Straße|Str\.|Platz|Allee|Gasse|Ring|Damm)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der) {_CAP}) \d{{1,4}}(?: ?[a-z](?![\w-]))?",
    rf"\d{{1,4}}(?: ?(?:bis|ter|[A-Z]))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|square)(?: de la| de l'| du| des| de| d')?[ ']?{_CAP}(?: {_CAP})?",
    rf"(?:Calle|C/|Avda\.|Avda|Av\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera)(?: de la| de los| de las| del| de)? ?{_CAP}(?: {_CAP})?,? (?:n\.?º ?)?\d{{1,4}}(?:, \d{{1,2}}\.?[ºª](?: ?[A-Z](?!\w))?)?",
    rf"(?:\d{{1,4}},? {_VIA}|{_VIA},? \d{{1,4}})",
    rf"(?:ul\.|al\.|pl\.) {_CAP}(?: {_CAP})? \d{{1,4}}(?:/\d{{1,4}})?",
]
_WEST = [re.compile(rf"(?<![\w/]){s}{_TAIL}") for s in _STREET]
# Words that an address has; only their surroundings are searched.
_WEST_HINTS = (
    "Street St. St, Lane Ln Road Rd Avenue Ave Terrace Way Drive Court Place Close Row Square Hill Boulevard Blvd Crescent Gardens Grove Mews Parade Walk Box Postfach Apartado Boîte BP B.P str. straße strasse weg Weg platz Platz gasse Gasse allee Allee ring ufer damm Ring Damm Straße Str. rue avenue av. boulevard bd chemin allée impasse quai route cours Calle C/ Avda Av. Avenida Plaza Pza Paseo Camino Ronda Travesía Carretera Via Viale Piazza Corso Largo Vicolo ul. al. pl."
).split() + ["Am ", "An der ", "An den ", "Im ", "In der ", "Zum ", "Zur ", "Auf de", "Unter den ", "Hinter der ", " place d", " square d"]
#: Ends of German street names, hints only before a number; the small ones within a word, as no other hint is.
_NUMBERED = frozenset("str. straße strasse weg Weg platz Platz gasse Gasse allee Allee ring ufer damm Ring Damm Straße Str.".split())
_EAST_HINTS = ("号", "丁目", "番地", "番")
_HAN = "㐀-䶿一-鿿々"
_CJK = re.compile(f"[{_HAN}぀-ヿ]")
_EAST = [
    re.compile(rf"(?:〒?\d{{3}}-\d{{4}}[ 　]?)?(?:[{_HAN}]{{1,6}}(?:省|自治区|都|道|府|県))?[{_HAN}]{{1,6}}[市县縣郡区區][{_HAN}]{{1,10}}(?:路|街|大道|巷|弄|里)\d+号(?:\d+(?:号楼|栋|幢))?(?:\d+单元)?(?:\d+(?:室|楼|层))?"),
    re.compile(rf"(?:〒?\d{{3}}-\d{{4}}[ 　]?)?(?:[{_HAN}]{{1,4}}(?:都|道|府|県))?[{_HAN}]{{1,6}}[市区郡][{_HAN}ヶケノ]{{1,10}}\d+(?:丁目\d+番\d+号|丁目\d+番地?|丁目\d+(?:-\d+)*|番地?\d*号?|(?:-\d+){{1,3}})(?:[ 　]?\d+号室)?"),
]
# Words that come before an address in running text and are no part of it.
_EAST_LEAD = re.compile(r"^.*?(?:地址|住所|住址|位于|保管在|保管于|存放于|存于|寄往|寄至|请寄|書類は|宛先|放在|在|は|へ|を|に|の|：|，)(?=.)")


def _addresses(text: str, west: list[int], east: list[int]) -> Iterator[tuple[int, int]]:
    """Addresses around the places of hints."""
    for low, high in _windows(text, west):
        for pattern in _WEST:
            for m in pattern.finditer(text, low, high):
                yield m.span()
    for low, high in _windows(text, east):
        for pattern in _EAST:
            for m in pattern.finditer(text, low, high):
                lead = _EAST_LEAD.match(m.group())
                yield m.start() + (lead.end() if lead else 0), m.end()


def _windows(text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    """The lines of places in order, with the line before and the two after, joined where they overlap."""
    low = high = None
    for at in places:
        if high is not None and at < last:
            continue  # within the line before
        first = text.rfind("\n", 0, at)
        before = text.rfind("\n", 0, first) + 1 if first > 0 else 0
        last = text.find("\n", at)
        last = len(text) if last < 0 else last
        after = last
        for _ in range(2):
            after = text.find("\n", after + 1) if after < len(text) else len(text)
            after = len(text) if after < 0 else after
        if high is not None and before > high:
            yield low, high
            low = None
        low = before if low is None else low
        high = after
    if high is not None:
        yield low, high


# ---------------------------------------------------------------- names

# Particles of family names.
_PARTICLE = r"(?:de la|de las|de los|del|della|de|den|der|dos|das|da|di|do|du|van der|van den|van|von der|von|zu|af|av|ten|ter|la|le|el|al|bin|ibn|y|e|O'|d')"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BETWEEN = re.compile(rf"(?:[ \n]{_PARTICLE})*[ \n]", re.I)
_INITIAL = re.compile(r"[ \n]?[^\W\d_]\.(?:[ -]?[^\W\d_]\.)*(?=[ \n-])")
_FIRST_INITIAL = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.[ \n-]?){1,3}$")
_FRENCH = re.compile(r"\bpar[ \n]$")
_LAST_INITIAL = re.compile(r"[ \n][^\W\d_]\.(?![^\W\d_])")


class NameParts:
    """Which words are given or family names, learnt from a list of name parts.

    A word is one if the list has it, or if it falls into a beginning and an
    ending that several listed names of one role have (an incomplete list of
    compound names vouches for the compounds that it lacks).
    """

    def __init__(self, parts: list[tuple[str, str]], support: int = 2):
        self.listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for part, role in parts:
            if part and role in self.listed:
                self.listed[role].add(part.casefold())
        self.heads, self.tails = {}, {}
        for role, words in self.listed.items():
            heads, tails = Counter(), Counter()
            for w in words:
                for k in range(3, len(w) - 1):
                    heads[w[:k]] += 1
                    tails[w[k:]] += 1
            self.heads[role] = {h for h, n in heads.items() if n >= support}
            self.tails[role] = {t for t, n in tails.items() if n >= support}
        self.known: dict[str, str] = {}
        beginnings = {w[:3] for role in self.listed for w in (*self.listed[role], *self.heads[role]) if len(w) >= 3}
        self.hints = _hints(beginnings)

    def roles(self, word: str) -> str:
        """``g``, ``f``, both or neither."""
        found = self.known.get(word)
        if found is None:
            w = word.casefold()
            found = "".join(role[0] for role in ("given", "family") if w in self.listed[role] or self._compound(w, role))
            if len(self.known) < 500_000:
                self.known[word] = found
        return found

    def _compound(self, w: str, role: str) -> bool:
        heads, tails = self.heads[role], self.tails[role]
        return any(w[:k] in heads and w[k:] in tails for k in range(3, len(w) - 1))


def _hints(beginnings: set[str]):
    """An automaton that finds, in one pass over a text, the places that need a closer look."""
    import ahocorasick

    found: dict[str, str] = {}

    def add(kind: str, words: Iterable[str]) -> None:
        for w in words:
            found[w] = found.get(w, "") + kind

    add("n", {v for w in beginnings for v in (w, w.upper(), w.capitalize())})
    add("w", _WEST_HINTS)
    add("e", _EAST_HINTS)
    add("c", _WEST_CUES)
    add("p", _EAST_LABELS)
    hints = ahocorasick.Automaton()
    for word, kinds in found.items():
        hints.add_word(word, (len(word), kinds, kinds != "n" and word[0].isascii() and word[0].isalpha() and not (word[0].islower() and word in _NUMBERED)))
    hints.make_automaton()
    return hints


def _western_names(text: str, parts: NameParts, places: list[int]) -> Iterator[tuple[int, int]]:
    roles, tokens = parts.roles, []
    for at in places:
        if at and text[at - 1].isalpha() and not (text[at - 1].islower() and text[at].isupper()):
            continue
        m = _TOKEN.match(text, at)
        if tokens and at < tokens[-1][1]:
            continue
        role = roles(m.group())
        if role:
            tokens.append((at, m.end(), role))
        elif not m.group().isupper() and (inner := re.search(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", m.group())) and (role := roles(m.group()[: inner.start()])):
            # a double name whose hyphen was taken for one at a line end
            tokens.append((at, at + inner.start(), role))
    used = 0
    for i, (start, end, role) in enumerate(tokens):
        if start < used:
            continue
        found = None
        if "g" in role:
            found = _given_first(text, tokens, i)
        if not found and "f" in role:
            found = _family_first(text, tokens, i)
        if found:
            yield found
            used = found[1]


def _family(text: str, tokens: list, i: int) -> int:
    """End of a family name of one or more parts joined by hyphens, that starts with token i."""
    end = tokens[i][1]
    while i + 1 < len(tokens) and text[end : tokens[i + 1][0]] in ("", "-", "- ", "-\n") and "f" in tokens[i + 1][2]:
        i += 1
        end = tokens[i][1]
    return end


def _named(text: str, start: int, end: int) -> bool:
    """Whether the words are written as names: all small, or each with a capital."""
    words = [w for w in re.findall(r"[^\W\d_]{3,}", text[start:end])]
    capitals = sum(w[0].isupper() for w in words)
    return capitals == len(words) or capitals == 0 or capitals >= 2


def _given_first(text: str, tokens: list, i: int) -> tuple[int, int] | None:
    start, end, _ = tokens[i]
    at, j = end, i + 1
    # second given names
    while j < len(tokens) and "g" in tokens[j][2] and "f" not in tokens[j][2] and text[at : tokens[j][0]] in (" ", "-", "\n"):
        at, j = tokens[j][1], j + 1
    initial = _INITIAL.match(text, at)
    if initial:
        at = initial.end()
    if j < len(tokens) and "f" in tokens[j][2]:
        between = _BETWEEN.fullmatch(text, at, tokens[j][0])
        if between:
            last = _family(text, tokens, j)
            return (start, last) if _named(text, start, last) else None
    return None


def _family_first(text: str, tokens: list, i: int) -> tuple[int, int] | None:
    start, end = tokens[i][0], _family(text, tokens, i)
    lead = _FIRST_INITIAL.search(text, max(0, start - 10), start)
    if lead and lead.group().startswith("M.") and _FRENCH.search(text, max(0, lead.start() - 12), lead.start()):
        # the French title, before initials or a whole name
        title = lead.start() + 3
        lead = _FIRST_INITIAL.search(text, title, start) if title < start else None
    if lead:
        return lead.start(), end
    particle = re.search(rf"(?<![^\W_])((?:[^\W\d_]\.[ \n-]?){{1,3}})(?:{_PARTICLE}[ \n])+$", text[max(0, start - 24) : start])
    if particle:
        return max(0, start - 24) + particle.start(), end
    j = next((j for j in range(i + 1, len(tokens)) if tokens[j][0] >= end), None)
    if j is not None and "g" in tokens[j][2] and text[end : tokens[j][0]] in (", ", " ", ",\n", "\n", ","):
        # the given name may itself begin the next name, as in a list of names given first
        last = tokens[j][1]
        follows = _given_first(text, tokens, j)
        if follows and text[end : tokens[j][0]] != ", ":
            return None
        initial = _LAST_INITIAL.match(text, last)
        if initial:
            last = initial.end()
        return (start, last) if _named(text, start, last) else None
    initial = re.compile(r",? (?:[^\W\d_]\.[ -]?){1,2}(?![^\W\d_])").match(text, end)
    if initial and "," in initial.group():
        return start, len(text[: initial.end()].rstrip(" -"))
    return None


# Labels before a person in Chinese and Japanese text.
_EAST_LABELS = "发明人 發明人 发明者 発明者 申请人代表 代理人 签名 签署人 署名 姓名 氏名 联系人 連絡者 担当者 作成者 设计人 検査者 操作员 试验员 見証人 见证人 (72) (74) (75) 先生 女士 氏 様 さん 教授 博士".split()
_EAST_NAME = re.compile(rf"[^ :：\n]{{1,6}}[:： ]?[ 　]?([{_HAN}]{{2,5}})(?![{_HAN}぀-ヿ])")
_EAST_NEXT = re.compile(rf"[ 　]?[;；/、,，][ 　]?([{_HAN}]{{2,5}})(?![{_HAN}぀-ヿ：:])")
_EAST_TITLE = re.compile(rf"(?<![{_HAN}])([{_HAN}]{{2,5}}?)(?:先生|女士|氏|様|さん|教授|博士)(?![{_HAN}])")
# Words before a person in European text.
_WEST_CUES = "Inventor Erfinder Inventeur (72) (74) (75) Frau Herr Mr Mrs Ms Dr Prof Mme Mlle Sr. Sra. signed witnessed gezeichnet Gezeichnet Signé signé Firmado firmado".split()
_WEST_CUED = re.compile(
    rf"(?:Inventor(?:s|es)?|Erfinder(?:in)?|Inventeur(?:s|e)?|\(7[245]\)(?: Dr\.| Prof\.)?|Frau|Herrn?|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Mme|Mlle|Sr\.|Sra\.|signed by|witnessed by|[Gg]ezeichnet|[Ss]igné|[Ff]irmado por)"
    rf" ?[:：]? ?((?:{_CAP},? )(?:[^\W\d_]\. )?(?:{_PARTICLE} )*{_CAP}|[^\W\d_]\. (?:{_PARTICLE} )*{_CAP})(?=[ ]?(?:$|[\n;,/(<。、，]|\.|tel|und |and |et |y ))"
)
# Words that end the names of firms, and of things named after people.
_FIRM = re.compile(r"(?:[ \n]& [^\W\d_]+)?[ \n](?:GmbH|AG|KG|Ltd|Inc|SA|SAS|AB|S\.L|S\.A|K\.K|LLC|Corp|Co|Works|Systems|Motors|Energy|number|test|relation|unit|Process)\b")


def _eastern_names(text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    for place in places:
        m = _EAST_NAME.match(text, place)
        if m and _EAST_LABEL.match(text, place, m.start(1)):
            yield m.span(1)
            at = m.end()
            while n := _EAST_NEXT.match(text, at):
                yield n.span(1)
                at = n.end()
        for m in _EAST_TITLE.finditer(text, max(0, place - 5), min(len(text), place + 3)):
            yield m.span(1)


_EAST_LABEL = re.compile("(?:" + "|".join(re.escape(w) for w in _EAST_LABELS[:-7]) + ")[:： ]?[ 　]?$")


# ---------------------------------------------------------------- all together


def find_spans(source: str, parts: NameParts) -> list[tuple[int, int, str]]:
    """Source spans of personal information, in order and apart from each other."""
    plain = Plain(source)
    text = plain.text
    places: dict[str, list[int]] = {kind: [] for kind in "nwecp"}
    for last, (length, kinds, bounded) in parts.hints.iter(text):
        at = last - length + 1
        for kind in kinds:
            if kind == "w" and (bounded and at and text[at - 1].isalpha() or text[at:last + 1] in _NUMBERED and not text[last + 2 : last + 3].isdigit()):
                continue
            places[kind].append(at)
    found = [(a, b, EMAIL) for a, b in _emails(text)]
    found += [(a, b, ADDRESS) for a, b in _addresses(text, sorted(places["w"]), sorted(places["e"]))]
    masked = _masked(text, sorted((a, b) for a, b, _ in found))
    found += list(_numbers(masked))
    found += [(a, b, NAME) for a, b in _western_names(masked, parts, sorted(x for x in places["n"] if masked[x] != "\x00")) if not _FIRM.match(masked, b)]
    if places["p"]:
        found += [(a, b, NAME) for a, b in _eastern_names(masked, places["p"])]
    for at in places["c"]:
        m = _WEST_CUED.match(masked, at)
        if m and not _FIRM.match(masked, m.end(1)):
            found.append((*m.span(1), NAME))
    kept, last = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last:
            kept.append((*plain.span(a, b), kind))
            last = b
    return kept


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans blanked, at the same length."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if b > at:
            a = max(a, at)
            out += [text[at:a], "\x00" * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def as_found(passage: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in passage.lower() if c.isalnum())


def redacted(source: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [source[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, source[at:]])


# ---------------------------------------------------------------- Spark

#: A list of name parts is sent to the tasks up to this many rows.
MOST_NAME_PARTS = 200_000


def load_name_parts(name_parts: DataFrame) -> list[tuple[str, str]]:
    """The rows of a small dictionary (``name_part``, ``role``), refused beyond ``MOST_NAME_PARTS``."""
    rows = name_parts.select("name_part", "role").where("name_part is not null and role is not null").distinct().limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"more than {MOST_NAME_PARTS} name parts")
    return sorted((r.name_part, r.role) for r in rows)


def find_personal_information(documents: DataFrame, ident: str, text: str, name_parts: DataFrame) -> DataFrame:
    """Every passage of personal information: ``ident``, ``kind``, ``start``, ``end``, ``passage``, ``found``.

    ``start`` and ``end`` are code points of the source text; ``found`` is the
    passage lower-cased with only letters and digits.  Texts are searched
    whole, after undoing disguises; the spans refer to the text as written.
    Null and empty texts give no row; a document repeated under one id gives
    its rows again; other columns are ignored; without name parts, names are
    found by labels and titles only.  No shuffle.
    """
    parts = load_name_parts(name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = NameParts(parts)
        for batch in batches:
            rows = []
            for key, source in zip(batch["key"], batch["text"]):
                for a, b, kind in find_spans(source, known):
                    rows.append((key, kind, a, b, source[a:b], as_found(source[a:b])))
            yield pd.DataFrame(rows, columns=["key", "kind", "start", "end", "passage", "found"])

    wanted = documents.select(documents[ident].alias("key"), documents[text].alias("text")).where("text is not null and text <> ''")
    key = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInPandas(run, f"key {key}, kind string, start int, end int, passage string, found string").withColumnRenamed("key", ident)


def redact_personal_information(documents: DataFrame, ident: str, text: str, name_parts: DataFrame) -> DataFrame:
    """``ident``, ``text`` with ``[EMAIL]``, ``[PHONE]`` ... for each passage, and ``n_redacted``.

    One row per row of ``documents``; null stays null, empty stays empty; all
    other characters stay as they are.
    """
    parts = load_name_parts(name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = NameParts(parts)
        for batch in batches:
            spans = [find_spans(source, known) if isinstance(source, str) else [] for source in batch["text"]]
            texts = [redacted(source, s) if isinstance(source, str) else None for source, s in zip(batch["text"], spans)]
            yield pd.DataFrame({"key": batch["key"], "text": texts, "n_redacted": [len(s) for s in spans]})

    wanted = documents.select(documents[ident].alias("key"), documents[text].alias("text"))
    key = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInPandas(run, f"key {key}, text string, n_redacted int").withColumnRenamed("key", ident)
