"""Personal information in free text: finding it and putting placeholders in its place.

Regular expressions propose spans; checksums confirm numbers that have one; what stands
beside a span, and for names a list of name parts, adds to or takes from its score, and
spans over a threshold are taken. Where spans overlap, the kinds win in the order of
KINDS, then the longer span.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

KINDS = ("email", "idnum", "phone", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
THRESHOLD = 3
#: Texts of more characters than this are spread over tasks.
SPREAD_OVER = 1 << 20


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- e-mail addresses --------------------------------------------------------------------

# Begins with a class, which is looked for much faster than alternatives.
_AT = re.compile(r"[@A(\[{<](?:(?<=@)(?:\\,|\$)?|(?<=\sA)T\s+|(?<=[(\[{<])\s*(?:at|AT|At)\s*[)\]}>]\s*)")
_LOCAL_END = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9.+%'\-]|\\?_)*)?[A-Za-z0-9]\Z")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|DOT|Dot)\s*[)\]}>]\s*|\s+DOT\s+|\\,\.\\,)"
_DOMAIN = re.compile(rf"(?:{_LABEL}{_DOT})+[A-Za-z]{{2,24}}(?![A-Za-z0-9])")


def emails(text: str) -> Iterator[Span]:
    for at in _AT.finditer(text):
        domain = _DOMAIN.match(text, at.end())
        if not domain:
            continue
        end = at.start()
        if at[0][0] == "@":
            end -= 2 if text.endswith("\\,", 0, end) else text.endswith("$", 0, end)
        while end and at[0][0] != "@" and text[end - 1].isspace():
            end -= 1
        begin = end  # the whole of what may be a local part, however long it is
        while begin and (text[begin - 1] in ".+%'-_\\" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        local = _LOCAL_END.search(text, begin, end)
        # Two spelled-out words need a spelled-out dot as well.
        if local and not (at[0].startswith("AT") and not re.search(r"(?i)dot", domain[0])):
            yield Span(local.start(), domain.end(), "email")


# --- numbers -----------------------------------------------------------------------------

_GAP = r"(?:--|[\-. ~\u00a0\u2009\u202f\u2010-\u2014]|\\[,; ]|\\~\{\}|\r?\n)"
_PHONE = re.compile(
    rf"(?<![\w+.\-/])(?:"
    rf"\+[1-9]\d{{8,14}}|\+[1-9]\d{{0,2}}(?:{_GAP}?\(?\d{{1,5}}\)?){{2,6}}"
    rf"|00[1-9]\d{{0,2}}{_GAP}\d{{1,4}}(?:{_GAP}\d{{2,5}}){{1,4}}"
    rf"|\(0?\d{{2,4}}\){_GAP}?\d{{3,5}}{_GAP}\d{{3,5}}"
    rf"|\d{{3}}(?P<g>{_GAP})\d{{3}}(?P=g)\d{{4}}"
    rf"|0\d(?:{_GAP}\d\d){{4}}"
    rf")(?!\d|[\-.]?\d|-[A-Za-z]|[A-Za-z])"
)
_CALLED = re.compile(r"(?i)(?:tel|phone|fax|cell|call|mobile?|telefon|labphone)[^\n]{0,12}$|,\s*$|fax:?\s*$")
#: What numbers other than telephone numbers are of: things that are numbered or measured.
_COUNTED = re.compile(
    r"(?i)(?:\b(?:grants?|awards?|projects?|contracts?|runs?|jobs?|batch(?:es)?|lots?|samples?|specimens?|compounds?|isbn|issn|doi|data ?sets?|seeds?|pp?\.|pages?|versions?|builds?|releases?|orcid|id|no\.|nr\.|numbers?"
    r"|codes?|serial|accession|catalog(?:ue)?|chapters?|sections?|eqs?\.|figs?\.|tables?|ref(?:s|\.)?|entr(?:y|ies)|items?|cas)"
    r"|\b(?!phone|fax|tel|number|line|contact|mobile|cell|extension)\w+\s+(?:is|are|was|were|equals?|=|of|between|from))[\s~:#]*$"
)

#: Any number in groups, on one line, right after a label.
_NUMBER_GAP = r"(?:--|[\-. ~\u00a0\u2009\u202f\u2010-\u2014]|\\[,; ]|\\~\{\}| ?/ ?)"
_LABELLED = re.compile(
    rf"[tTpPfFmM](?<![\w\\].)(?i:(?<=t)(?:[eé]l[eé](?:[pf]h?on[eo]?|fax)|[eé]l)|(?<=p)h(?:one)?|(?<=f)a(?:x|csimile)|(?<=m)obile?)\b\.?(?i:[\s~]*(?:no\b\.?|nr\b\.?|number|\#))?(?:[\s~:{{]|\\[ ,])*"
    rf"(?P<n>(?!0\.)(?>[+(]?\+?\d{{1,5}}\)?(?:(?:{_NUMBER_GAP}|(?<=\)))\(?\d{{1,8}}\)?){{1,7}}))(?!\d|[\-./]?\d|-[A-Za-z]|[A-Za-z])"
)


def phones(text: str) -> Iterator[Span]:
    named = [m.span("n") for m in _LABELLED.finditer(text) if 6 <= sum(c.isdigit() for c in m["n"]) <= 15]
    strict = list(_strict_phones(text))
    begun = [s.start for s in strict]
    for start, end in named:
        i = bisect_right(begun, start)
        # What has a strict shape from here on is that.
        if not (i and strict[i - 1].end > start):
            yield Span(start, end, "phone")
    yield from strict


def _strict_phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        before = text[max(0, m.start() - 24) : m.start()]
        score = 4 if m[0][0] in "+(" or m[0].startswith("00") else 2 if m["g"] and m["g"].isspace() else 3
        score += 2 * bool(_CALLED.search(before)) - 4 * bool(_COUNTED.search(before))
        if 9 <= digits <= 15 and score >= THRESHOLD:
            yield Span(m.start(), m.end(), "phone")


_JOIN = r"(?:--|[\-\u2010-\u2014 ~\u00a0]|\\[, ])?"
_ISO7064 = re.compile(rf"(?<![\w\-.])\d{{4}}{_JOIN}\d{{4}}{_JOIN}\d{{4}}{_JOIN}\d{{3}}[\dXx](?![\w]|-\w)")
_NAMED = re.compile(
    rf"(?i:\bSSN|\bsocial\s+security\s+(?:number|no\.?|\#)|\bsoc\.\s*sec\.\s*(?:no\.?|number))(?:[\s:~\#{{]|\\[ \#])*(?P<ssn>\d{{3}}{_JOIN}\d\d{_JOIN}\d{{4}})(?![\d]|-\d)"
    r"|(?i:\bpassport|\b(?:ID|identity)\s+card)(?:[\s~]*(?i:no\.?|number|\#))?(?:[\s:~\#{]|\\[ \#])*(?P<card>[A-Z]{1,3}[ ]?\d{6,9})(?![\w])"
)


def check_character(digits: str) -> str:
    """ISO 7064 MOD 11-2."""
    total = 0
    for d in digits:
        total = (total + int(d)) * 2 % 11
    return "0123456789X"[(12 - total) % 11]


#: A text without any of these words has no named number.
_NAMED_WORDS = ("ssn", "soc", "passport", "card")


def idnums(text: str) -> Iterator[Span]:
    for m in _ISO7064.finditer(text):
        bare = "".join(c for c in m[0] if c.isalnum()).upper()
        before = text[max(0, m.start() - 16) : m.start()]
        if check_character(bare[:-1]) == bare[-1] and not re.search(r"(?i)data\s*set[\s~]*$", before):
            yield Span(m.start(), m.end(), "idnum")
    low = text.lower()
    for m in _NAMED.finditer(text) if any(w in low for w in _NAMED_WORDS) else ():
        yield Span(*m.span("ssn" if m["ssn"] else "card"), "idnum")


# --- street addresses --------------------------------------------------------------------

# Latin, Greek and Cyrillic; scripts without capitals are found by lists of names only.
_UPPER = r"A-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u017f\u0386-\u038f\u0391-\u03ab\u0400-\u042f"
_LETTER = r"A-Za-z\u00aa\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u052f"
_DENSE = r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3"
_ACCENT = r"(?:\{?\\(?:[\"'`^~=.]\s?(?:\{\\?[A-Za-z]\s?\}|\\?[A-Za-z])|[uvHcdbkr]\{[A-Za-z]\}|(?:aa|AA|ae|AE|oe|OE|ss|[oOlLij])(?:\{\}|\s(?=[a-z])|(?![A-Za-z])))\}?)"
_WORD = rf"(?:[{_UPPER}]|{_ACCENT})(?:[{_LETTER}]|{_ACCENT})*(?:['’\-][{_LETTER}](?:[{_LETTER}]|{_ACCENT})*)*"
_S = r"(?:[ \t\u00a0\u2009\u202f]*\r?\n(?:%+)?[ \t]*|[ \t\u00a0\u2009\u202f]+|~|\\ |\\,)"
_NO = r"\d{1,4}[a-zA-Z]?(?:(?:--|[\-/\u2013])\d{1,4}[a-zA-Z]?)?(?!\w)"
_ADDRESS = re.compile(
    rf"(?<![\w.\-/])(?:"
    rf"{_NO}{_S}(?:{_WORD}{_S}){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Square|Boulevard|Court|Place|Terrace|Way|(?:St|Sq|Rd|Ave|Ln|Dr|Blvd)\.)(?![A-Za-z])"
    rf"|{_NO},?{_S}(?:rue|avenue|boulevard|place|quai|impasse|chemin){_S}(?:(?:de{_S}la|des?|du){_S}|d['’]|de{_S}l['’])?{_WORD}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Corso){_S}(?:(?:de{_S}la|del?|della?|dei){_S})?{_WORD}(?:{_S}{_WORD})?,?{_S}{_NO}"
    rf"|{_WORD}(?:(?<=stra)(?:ß|ss)e|(?<=stra)\\ss\{{\}}e|(?<=str)\.|(?<=weg)|(?<=platz)|(?<=gasse)|(?<=allee)|(?<=straße)|(?<=strasse)|(?<=\\ss\{{\}}e)){_S}{_NO}"
    rf")"
)
_ELSEWHERE = re.compile("[\u0400-\u04ff\u4e00-\u9fff]")
_ADDRESS_ELSEWHERE = re.compile(
    rf"[уУпПнНшШбБ\u4e00-\u9fff](?:(?<!\w.)(?i:(?<=у)(?:л\.|лица)|(?<=п)(?:роспект|росп\.|р\.|лощадь|л\.|ереулок|ер\.)|(?<=н)(?:абережная|аб\.)|(?<=ш)оссе|(?<=б)ульвар){_S}?{_WORD}(?:{_S}{_WORD})?,?{_S}(?:(?:д\.|дом){_S}?)?\d{{1,4}}[а-яА-Яa-zA-Z]?(?:[/\-]\d{{1,4}})?(?!\w)"
    rf"|(?<=[\u4e00-\u9fff])(?<![省市区县镇乡在于是到住见])(?:(?![省市区县镇乡在于是到住见])[\u4e00-\u9fff]){{0,4}}?(?:大街|大道|路|街|巷|胡同){_S}?\d{{1,5}}{_S}?[号號])"
)


def addresses(text: str) -> Iterator[Span]:
    for m in _ADDRESS.finditer(text):
        yield Span(m.start(), m.end(), "address")
    if not text.isascii() and _ELSEWHERE.search(text):
        for m in _ADDRESS_ELSEWHERE.finditer(text):
            yield Span(m.start(), m.end(), "address")


# --- names -------------------------------------------------------------------------------

_PARTICLE = r"(?:[Vv]an|[Vv]on|VAN|VON|[Dd]e|DE|[Dd]er|DER|[Dd]en|DEN|[Ll]a|LA|[Ll]e|LE|[Dd]el|[Dd]ella|[Dd]i|[Dd]a|[Dd]os|[Dd]u|[Tt]en|TEN|[Tt]er|TER|[Zz]u)"
_NAMEWORD = rf"(?:[dD]['’]|[aA]l-|[eE]l-)?{_WORD}"
_INITIAL = rf"[{_UPPER}]\.(?:-?[{_UPPER}]\.)*"
_RUN = re.compile(rf"(?<![\w\\@.\-'’]){_NAMEWORD}(?:{_S}?,{_S}{_NAMEWORD}|{_S}(?:{_INITIAL}(?![A-Za-z])|(?:{_PARTICLE}{_S}){{0,2}}{_NAMEWORD}))+")
_TOKEN = re.compile(rf"(?P<comma>,)|(?P<initial>{_INITIAL}(?![A-Za-z]))|(?P<particle>{_PARTICLE}(?={_S}))|(?P<word>{_NAMEWORD})")
_LED = re.compile(rf"(?:(?<!\w){_PARTICLE}{_S}){{1,2}}$")
#: What stands right before a person and makes two capitalized words a name that no list has: titles, author fields
#: of LaTeX and BibTeX, verbs of speaking to somebody, words for persons and for what they exchange, what was done by
#: them or given to them, the name in a note of source text, and labels of people in forms and letters.
_TITLE = r"(?:Mrs?|Ms|Dr|Prof|Fr|Hr|Sra?|St)\.|(?:Miss|Mme|Mlle|Professor|Doctor|Herrn?|Frau|Monsieur|Madame|Señora?)\b"
_INTRODUCED = re.compile(
    r"(?:\\author(?:\[[^\]]*\])?\s*\{|\\and|\b(?:author|editor)\s*=\s*[{\"]"
    r"|(?i:\b(?:thank|thanks\s+to|ask|tell|told|contact|e-?mail|phone|consult|invite|meet|met|visit|remind|inform|notify|congratulate|credit|acknowledge)(?:s|ed|ing)?)"
    r"|(?i:\b(?:discussions?|conversations?|correspondence|communications?|collaborations?|letters?|e-?mails?|talks?|meetings?|exchanges?|work(?:ed|ing)?|visits?)\s+(?:with|from|to|by))"
    r"|(?i:\b(?:colleagues?|volunteers?|participants?|patients?|students?|authors?|editors?|referees?|reviewers?|supervisors?|advis[eo]rs?|collaborators?|friends?|donors?|witness(?:es)?|respondents?|teachers?|assistants?)(?:\s*[(,:])?)"
    r"|(?i:\b(?:noticed|noted|observed|suggested|proposed|pointed\s+out|communicated|found|shown|proved|proven|provided|reported|written|reviewed|remarked|conjectured|introduced|supplied|discovered|asked|raised|taken|signed)\s+by)"
    r"|(?i:\b(?:sen[dt]|ships?|shipped|mail|lend|lent|giv(?:e|en)|hand(?:ed)?|forward(?:ed)?|return(?:ed)?|submit(?:ted)?|address(?:ed)?|assign(?:ed)?|deliver(?:ed)?|bring|brought|show)(?:\s+(?!to\b)[\w'\-]+){0,4}\s+to)"
    r"|\b(?:NOTE|TODO|FIXME|XXX|REVIEW|CHECK)\s*\("
    r"|(?i:\b(?:letter|contact|attn\.?|attention|author|reviewer|editor|signed|name|cc)\s*:)"
    rf"|{_TITLE})[\s%~]*(?:(?:{_TITLE})[\s~]*)*$"
)
#: What stands before or after people, but not only there: confirms a name of which the list has one part.
_BEFORE = re.compile(
    r"(?i)(?<![\w\\])(?:by|with|to|from|of|following|after|per|see|via|thank\w*|acknowledg\w+|met|meet\w*|visit\w*|contact\w*|consult\w*|invit\w+|ask\w*|told|tell|remember\w*|join\w*|congratulat\w+|credit\w*|late|guests?|speakers?|lecturers?|chairs?|investigators?|inventors?|translators?"
    r"|colleagues?|co-?authors?|collaborators?|students?|advis[eo]rs?|supervisors?|friends?|teachers?|editors?|referees?|authors?|professor|doctor|sir|lady"
    r"|von|mit|durch|bei|dank\w*|herrn?|frau|kolleg\w+|par|avec|chez|merci|monsieur|madame|mm?e|mlle|por|con|gracias|señora?|sra?)\b\.?[\s~:({]*$"
)
_AFTER = re.compile(
    r"[})]*,?\s++(?:(?:who|whom|whose)\b|(?:(?:has|had|have|also|first|kindly|independently)\s+){0,2}(?:pointed\s+out|noted|noticed|suggested|asked|wrote|said|told|showed|proposed|found|observed|explained|provided|helped|kindly|agreed|remarked|conjectured|reported)\b)"
    r"|[})]*,?\s++(?:\(?(?:private|personal|pers\.|priv\.)\s+comm|(?:and|et)\s+(?:co-?workers|collaborators|colleagues|al\b))"
)
#: Between the people of a list; a title may follow.
_LISTED = r"\s*+(?:[,;]\s*+(?:(?:and|und|et|y)\b|\\?&)?|\\and\b|(?<=[\s~])(?:and|und|et|y|\\?&)(?=[\s~]))[\s~]*+(?:(?:Mrs?|Ms|Dr|Prof)\.[\s~]*+)*+"
_PAIRED = re.compile(r"\s+(?:and|und|et|y|\\?&)[\s~]+")
_LISTED_AFTER, _LISTED_BEFORE = re.compile(_LISTED), re.compile(rf"(?<![\s,;]){_LISTED}\Z")
_WITHIN = re.compile(r"[^\W\d_A-Z]{2}[\s~]+\(?\Z|[,;:(][\s~]*\Z")
_TO_CONTACT = re.compile(r"(?:(?![.?!;]\s|\r?\n\s*\r?\n)[\s\S])*")
_FROM_CONTACT = re.compile(r"[ \t~:,(){}<>\-]{0,6}")
#: Written with a capital at the start of a sentence or of a label, and no names unless the list has them.
_NO_NAMES = frozenset(
    "the a an this that these those in on at by for from with to of and or but if as we our they he she it its his her their there here when where while after before since because following"
    " using let given suppose assume consider note see recall however moreover thus hence then both each every all some any no not new cf per via figure fig table section theorem lemma chapter"
    " appendix equation proof definition remark algorithm proposition corollary example todo der die das ein eine im am bei mit nach wir von le la les un une des du nous selon par el los las una según por con professor doctor sir lady herr herrn frau monsieur madame señor señora president dean director captain".split()
)
_INSTITUTE = re.compile(r"(?i)(?:institut\w*|universit\w*|laborator\w*|foundation|fund|cent(?:er|re)|college|school|academy|museum|society|corpus|hospital|observatory|prize|award|theorem|lemma|conjecture|street|road|lane|avenue|drive|square)")
_INSTITUTE_BEFORE = re.compile(r"(?i)(?:institut\w*|universit\w*|academy|school|college|cent(?:er|re))\s+(?:of|for|de|du|f[uü]r)\s+(?:the\s+)?$")
_EPONYM_AFTER = re.compile(r"(?:'s|’s)?\s+(?:Institut\w*|University|Foundation|Fund|Center|Centre|College|School|Laborator\w*|Academy|corpus|lemma|theorem|conjecture|equation|inequality|method|transform|prize|award|algorithm)\b")
#: Letters that have a name of their own in LaTeX, fixed by that language.
_NAMED_LETTERS = {"aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "i": "i", "j": "j"}
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "k": "\u0328", "r": "\u030a"}
_MARKED = re.compile(r"\{?\\(?:([\"'`^~=.]|[uvHcdbkr](?=\{))\s?\{?\\?([A-Za-z])\s?\}?|(aa|AA|ae|AE|oe|OE|ss|[oOlLij])(?:\{\}|\s)?)\}?")


def folded(word: str) -> str:
    """A name part as it is looked up: letters instead of LaTeX, composed, in lower case."""
    if "\\" in word:
        word = _MARKED.sub(lambda m: m[2] + _MARKS[m[1]] if m[1] else _NAMED_LETTERS[m[3]], word)
    return unicodedata.normalize("NFC", word.replace("’", "'")).casefold()


class Names:
    """Finds names by the roles that name parts have in a list."""

    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.roles: dict[str, set[str]] = {}
        for part, role in parts:
            self.roles.setdefault(folded(part), set()).add(role)
        one = re.compile(rf"[{_DENSE}]+")
        families, givens = ("|".join(sorted((re.escape(p) for p, r in parts if r == role and one.fullmatch(p)), key=len, reverse=True)) for role in ("family", "given"))
        self.side_by_side = re.compile(f"(?:{families})[ ·]?(?:{givens})") if families and givens else None

    def has(self, word: str, role: str) -> bool:
        key = folded(word)
        if role in self.roles.get(key, ()):
            return True
        if role == "family":
            key = re.sub(r"^(?:[do]'|mac|[ae]l-)", "", key)
        pieces = key.split("-")
        return any(role in self.roles.get(p, ()) for p in pieces) if len(pieces) > 1 or role == "family" else False

    def spans(self, text: str, contacts: list[Span] | None = None) -> Iterator[Span]:
        """contacts: e-mail addresses and numbers of the text, which confirm names beside them."""
        sure: list[Span] = []
        half: list[tuple[Span, list[str]]] = []
        for run in _RUN.finditer(text):
            self._of_run(text, run.start(), run.end(), sure, half)
        more = list(self._confirmed(text, sure, half, contacts or [])) if half else []
        # A confirmed one may hold a found one: a given name more.
        starts = [s.start for s in sure]
        longer = {sure[i].start for m in more if (i := bisect_right(starts, m.start)) < len(sure) and sure[i].start < m.end}
        yield from (s for s in sure if s.start not in longer)
        yield from more
        yield from self.dense(text)

    def _of_run(self, text: str, start: int, end: int, sure: list[Span], half: list[tuple[Span, list[str]]]) -> None:
        tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        at = 0
        while at < len(tokens):
            got = self._from(text, tokens, at, sure)
            if got:
                span, at = got
                sure.append(span)
            else:
                half += self._half(text, tokens, at)
                at += 1

    def _half(self, text: str, tokens: list[tuple], at: int) -> list[tuple[Span, list[str]]]:
        """The name that may begin with this token if the list has only one part of it, or not its first one, and its unlisted words."""
        kind, word, start, _ = tokens[at]
        if kind != "word" or self._plain(word):
            return []
        if at and tokens[at - 1][0] not in ("comma", "particle") and not (tokens[at - 1][0] == "word" and self._plain(tokens[at - 1][1])):
            return []
        words = []
        for i in range(at, len(tokens)):
            if tokens[i][0] == "comma":
                break
            if tokens[i][0] == "word":
                words.append(i)
        if len(words) == 1 and at + 2 < len(tokens) and tokens[at + 1][0] == "comma" and tokens[at + 2][0] == "word":
            return self._half_turned(text, tokens, at)
        given = self.has(word, "given")
        last = next((i for i in words[1:] if self.has(tokens[i][1], "family")), None)
        if last is None and given:
            last = next((i for i in words[1:] if not self.has(tokens[i][1], "given")), words[1] if len(words) > 1 else None)
        if last is None:
            return []
        own = [tokens[i][1] for i in words if i <= last]
        if len(word) < 2 or len(tokens[last][1]) < 2 or any(self._plain(w) or _INSTITUTE.fullmatch(w) for w in own):
            return []
        follows = last + 1 < len(tokens) and _INSTITUTE.fullmatch(tokens[last + 1][1])
        if follows or _INSTITUTE_BEFORE.search(text[max(0, start - 40) : start]) or _EPONYM_AFTER.match(text, tokens[last][3]):
            return []
        return [(Span(start, tokens[last][3], "name"), [folded(w) for w in own if not self.has(w, "given") and not self.has(w, "family")])]

    def _half_turned(self, text: str, tokens: list[tuple], at: int) -> list[tuple[Span, list[str]]]:
        """Family name, comma, given name: an unlisted word and a listed given name, with nothing but initials after it."""
        word, given, last = tokens[at][1], tokens[at + 2][1], at + 2
        while last + 1 < len(tokens) and tokens[last + 1][0] == "initial":
            last += 1
        alone = last + 1 == len(tokens) or tokens[last + 1][0] == "comma"
        if not alone or not self.has(given, "given") or self.has(given, "family") or self.has(word, "given") or _INSTITUTE.fullmatch(word):
            return []
        led = _LED.search(text, max(0, tokens[at][2] - 40), tokens[at][2])
        return [(Span(led.start() if led else tokens[at][2], tokens[last][3], "name"), [folded(word)])]

    def _plain(self, word: str) -> bool:
        """A word of sentences that the list doesn't have."""
        return folded(word) in _NO_NAMES and not self.has(word, "given") and not self.has(word, "family")

    def _confirmed(self, text: str, sure: list[Span], half: list[tuple[Span, list[str]]], contacts: list[Span]) -> Iterator[Span]:
        """Those with a listed part (2) that what stands around or elsewhere in the text confirms (1)."""
        ends = [s.end for s in sure]
        open_, longer = [], []
        for s, words in half:
            i = bisect_right(ends, s.start)
            if i == len(ends) or sure[i].start >= s.end:
                open_.append((s, words))
            elif s.start < sure[i].start and s.end == sure[i].end:
                longer.append(s)
        begun, ended = {s.start for s in sure}, {s.end for s in sure}
        met = {folded(m["word"]) for s in sure for m in _TOKEN.finditer(text, s.start, s.end) if m["word"]}
        contacts = sorted(contacts)
        at = [c.start for c in contacts]

        def beside(s: Span) -> bool:
            i = bisect_right(at, s.end - 1)
            if i < len(at) and at[i] - s.end <= 40 and _TO_CONTACT.fullmatch(text, s.end, at[i]):
                return True
            return bool(i and contacts[i - 1].end <= s.start and _FROM_CONTACT.fullmatch(text, contacts[i - 1].end, s.start))

        def small(word: str) -> bool:
            return word in text and bool(re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text))

        def proper(s: Span) -> bool:
            """Within a sentence, of words that the text nowhere writes small."""
            words = (m["word"].lower() for m in _TOKEN.finditer(text, s.start, s.end) if m["word"])
            return bool(_WITHIN.search(text, max(0, s.start - 8), s.start)) and not any(map(small, words))

        def shown(s: Span) -> bool:
            return bool(_BEFORE.search(text, max(0, s.start - 40), s.start) or _AFTER.match(text, s.end)) or beside(s) or proper(s)

        def joined(s: Span, words: list[str]) -> bool:
            before = _LISTED_BEFORE.search(text, max(0, s.start - 24), s.start)
            after = _LISTED_AFTER.match(text, s.end)
            return bool(before and before.start() in ended or after and after.end() in begun) or any(w in met for w in words)

        # Only what stands right before it makes a word before a found name a part of it.
        yield from (s for s in longer if _BEFORE.search(text, max(0, s.start - 40), s.start))
        todo, test = open_, lambda s, words: shown(s) or joined(s, words)
        while todo:
            left, got = [], False
            for s, words in todo:
                if test(s, words):
                    got = True
                    begun.add(s.start)
                    ended.add(s.end)
                    met.update(words)
                    yield s
                else:
                    left.append((s, words))
            if not got:
                return
            # Each found one may confirm others before and after it.
            todo, test = left[::-1], joined

    def _from(self, text: str, tokens: list[tuple], at: int, sure: list[Span]) -> tuple[Span, int] | None:
        """The name that begins with this token, and the token after it. sure: the names found before it."""
        kind, word, start, _ = tokens[at]
        if kind != "word":
            return None
        before = text[max(0, start - 40) : start]
        introduced = bool(_INTRODUCED.search(before)) or (at == 0 and bool(sure) and self._after_introduced(text, sure[-1], start))
        led = _LED.search(before) if at == 0 or tokens[at - 1][0] != "word" else None
        if at + 2 < len(tokens) and tokens[at + 1][0] == "comma" and tokens[at + 2][0] == "word" and len(tokens[at + 2][1]) > 1:
            begin = led.start() + max(0, start - 40) if led else start
            if led:
                introduced = introduced or bool(_INTRODUCED.search(text[max(0, begin - 40) : begin]))
            last = at + 2
            while last + 1 < len(tokens) and tokens[last + 1][0] in ("initial", "word") and (tokens[last + 1][0] == "initial" or self.has(tokens[last + 1][1], "given")):
                last += 1
            score = 2 * self.has(word, "family") + 2 * self.has(tokens[at + 2][1], "given") + 3 * introduced
            family_first = not self.has(word, "given") or self.has(word, "family")
            if score >= THRESHOLD and family_first and not _INSTITUTE.fullmatch(word) and not _INSTITUTE_BEFORE.search(before):
                return Span(begin, tokens[last][3], "name"), last + 1
        # Given name first: up to the comma, or to the last family name that the list has.
        last = at
        while last + 1 < len(tokens) and tokens[last + 1][0] != "comma":
            last += 1
        while last > at and len(tokens[last][1]) == 1:
            last -= 1  # an initial that was cut off
        words = [i for i in range(at, last + 1) if tokens[i][0] == "word"]
        known = [i for i in words[1:] if self.has(tokens[i][1], "family")]
        given = self.has(word, "given")
        if not introduced and (not given or not known) or len(words) < 2:
            return None
        if known and not introduced:
            last = known[0]
        else:
            while tokens[last][0] != "word":
                last -= 1
        if last <= at:
            return None
        score = 2 * given + 2 * bool(known) + 3 * introduced
        between = [tokens[i][1] for i in range(at, last + 1) if tokens[i][0] == "word"]
        if any(_INSTITUTE.fullmatch(w) for w in between) or _INSTITUTE_BEFORE.search(before) or _EPONYM_AFTER.match(text, tokens[last][3]):
            return None
        return (Span(start, tokens[last][3], "name"), last + 1) if score >= THRESHOLD else None

    def _after_introduced(self, text: str, last: Span, start: int) -> bool:
        """The second of two people of whom the first was introduced by what stands before."""
        joined = start - last.end <= 12 and _PAIRED.fullmatch(text, last.end, start)
        return bool(joined and _INTRODUCED.search(text[max(0, last.start - 40) : last.start]))

    def dense(self, text: str) -> Iterator[Span]:
        """Listed family and given names side by side, in scripts without capitals and spaces."""
        if self.side_by_side:
            for m in self.side_by_side.finditer(text):
                yield Span(m.start(), m.end(), "name")


# --- all kinds ---------------------------------------------------------------------------


def found(text: str | None, names: Names) -> list[Span]:
    """Spans in order, without overlaps."""
    if not text:
        return []
    taken: list[Span] = []
    contacts: list[Span] = []
    for spans in (emails(text), idnums(text), phones(text), addresses(text), names.spans(text, contacts)):
        new = []
        for s in sorted(spans, key=lambda s: (s.start, -s.end)):
            i = bisect_right(taken, s.start, key=lambda t: t.start)
            free = (not i or taken[i - 1].end <= s.start) and (i == len(taken) or s.end <= taken[i].start)
            if free and (not new or new[-1].end <= s.start):
                new.append(s)
        taken = sorted([*taken, *new])
        contacts += [s for s in new if s.kind in ("email", "idnum", "phone")]
    return taken


def replaced(text: str | None, spans: list[Span]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


SCHEMA = "doc_id bigint, text string, items array<struct<kind:string,found:string>>"
ITEMS = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())]))
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def _sought(rows: DataFrame, key: str, kind: str, parts: DataFrame, text: str = "text") -> DataFrame:
    """key, text with placeholders and items of each row; parts has the name parts with their roles."""
    shared = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in parts.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                spans = [found(t, names) for t in texts]
                out = pa.array([replaced(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
                items = pa.array([[{"kind": s.kind, "found": t[s.start : s.end]} for s in x] for t, x in zip(texts, spans, strict=True)], ITEMS)
                yield pa.RecordBatch.from_arrays([part.column(0), out, items], names=["key", "text", "items"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string, items array<struct<kind:string,found:string>>")


def paragraphs(text: str, size: int) -> list[str]:
    """text in parts of at least size characters, each up to the end of a paragraph; no item goes over a blank line."""
    out, at = [], 0
    while at < len(text):
        end = _PARAGRAPH.search(text, at + size)
        out.append(text[at : end.end() if end else len(text)])
        at += len(out[-1])
    return out


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([paragraphs(t, size) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["row", "doc_id", "parts"])


def redacted(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text", spread_over: int = SPREAD_OVER) -> DataFrame:
    """doc_id, the text with placeholders, and the items that were there.

    A null text stays null, an empty one empty, both without items; a repeated row is
    treated like any other; null name parts or roles are ignored; extra columns are
    dropped. Everything outside the spans is unchanged to the character. Texts of more than
    spread_over characters are spread over tasks in parts that end with a paragraph; what
    confirms a name has to stand in the same part. name_parts is a list of words that each
    task has whole.
    """
    parts = name_parts.where("name_part is not null and part_role is not null").select("name_part", "part_role").distinct()
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    fits = F.col("text").isNull() | (F.length("text") <= spread_over)
    kind = texts.schema["doc_id"].dataType.simpleString()
    short = _sought(texts.where(fits), "doc_id", kind, parts).withColumnRenamed("key", "doc_id")
    numbered = texts.where(~fits).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = staged(numbered.mapInArrow(lambda it: _cut(it, max(1, spread_over // 4)), f"row bigint, doc_id {kind}, parts array<string>").select("row", "doc_id", F.posexplode("parts").alias("no", "text")), "parts")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = cut.select(F.struct("row", "doc_id", "no").alias("at"), "text").repartition(tasks, "at")
    done = _sought(named, "at", named.schema["at"].dataType.simpleString(), parts).groupBy("key.row", "key.doc_id").agg(F.array_sort(F.collect_list(F.struct("key.no", "text", "items"))).alias("all"))
    whole = done.select("doc_id", F.array_join("all.text", "").alias("text"), F.flatten("all.items").alias("items"))
    return short.unionByName(whole)


def items(redactions: DataFrame) -> DataFrame:
    """Each distinct item of each document."""
    return redactions.select("doc_id", F.inline(F.array_distinct("items")))
