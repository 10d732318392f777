"""Problem 8: sentence units of texts in any script.

Terminators, closing marks and continuing punctuation come from the Unicode Sentence_Break property (the sets are built from
the property at import, so all scripts' terminators count). On top lie the tailorings that the standard leaves to the
application: abbreviations by language, initials, marks that close a quotation, brackets and quotations that are not split,
block structure (fences, headings, list items, blank lines), and scripts that end sentences by a space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _having(prop: str) -> str:
    return "".join(regex.findall(rf"\p{{Sentence_Break={prop}}}", _ALL))


STERM, ATERM, CONTINUE = _having("STerm") + "…", _having("ATerm"), _having("SContinue")
_CLOSE = set(_having("Close")) - set("([{¿¡") | set("*_`")
# Pairs of quotation marks and brackets. The straight double mark pairs with itself.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "［": "］", "｛": "｝", "｢": "｣"}
_ENDS = {close: opening for opening, close in PAIRS.items()} | {"“": "„"}
_OPENING = set(PAIRS) | set("\"'‘`")
# Abbreviations that never end a sentence, by language, in lower case without the last full stop.
NEVER_END = {
    "en": "mr mrs ms dr prof st rev hon gen col capt lt sgt gov sen rep pres no nos fig figs eq eqs sec secs ch chs vol vols app abs art arts para paras ed eds vs cf approx ca pp p pg viz resp incl excl e.g i.e eg ie al max min tel ext dept univ assn bros messrs mt ft",
    "de": "hr fr dr prof nr nrn abs art bd bzw ca vgl z.b u.a d.h z.t i.d.r o.ä s.o s.u v.a m.e evtl ggf inkl exkl max min mind sog st str tel ing dipl abb kap zzgl abzgl bspw insb gem lt",
    "fr": "m mm mme mlle dr pr me art fig p pp env cf c.-à-d p.ex ex vol chap al éd n no st ste av bd tél réf",
    "es": "sr sra srta sres dr dra d dña prof núm num art arts fig figs pág págs p pp ej p.ej vol cap ed ee aprox av avda tel ud uds admón",
    "ru": "т.е т.к т.ч т.н им см ср рис табл п пп стр с гл ст ч кн изд напр проф акад доц гр тов ул пр пл кв корп тел акц",
    "pt": "sr sra dr dra exmo exma art fig pág núm vol",
    "it": "sig sigg sig.ra dott prof art fig pag cap",
    "hi": "डॉ प्रो सं पृ रु श्रीमती कु",
    "nl": "dhr mevr dr prof nr blz fig art bijv ca d.w.z o.a",
    "ar": "د أ م ص ج ط ت ق.م",
    "th": "ดร ศ รศ ผศ นพ พญ ทพ โทร พ.ศ ค.ศ ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค",
    "zh": "mr mrs ms dr prof st vs no vol fig eq p pp e.g i.e cf ca",
    "ja": "mr mrs ms dr prof st vs no vol fig eq p pp e.g i.e cf ca",
    "ko": "mr mrs ms dr prof st vs no vol fig eq p pp e.g i.e cf ca",
}
# Frequent words that tell the languages of the Latin script from one another.
FREQUENT = {
    "en": "a the and of to is was that it for with not this are be by from which they have has were he she or an as on at its in then there their would can will but more when only after",
    "de": "der die das und ist nicht ein eine einer den dem des mit von zu im in auf für wird werden sich auch wir sie es war bei als dass nie nur noch wenn aber oder nach aus um hat haben sind wurde an so am beim zum zur",
    "fr": "a le la les et est une des du de dans que qui pas pour sur au aux ce cette avec il elle nous ne se sont par un en soit sans plus mais ou où ont été trop si son sa ses ces",
    "es": "a el la los las y es de una del que en no por con para se su un al lo como más fue son este esta pero o sin sus ha han cada entre hay muy ya",
    "pt": "a o os as e é de uma do da dos das que em não por com para se um ao mais foi são este esta mas ou sem seu sua pelo pela",
    "it": "a il lo gli e è una di del della dei che in non per con si un al più sono questo questa nel ma o senza suo sua dalla alla",
    "nl": "de het een en is van niet dat met voor op zijn te in er aan ook door bij naar werd maar of als dan wordt geen nog",
}
# How the languages are named in metadata.
NAMES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "français": "fr", "francais": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "español": "es", "espanol": "es", "spa": "es", "portuguese": "pt", "por": "pt", "italian": "it", "ita": "it", "dutch": "nl", "nld": "nl", "russian": "ru", "rus": "ru", "русский": "ru", "hindi": "hi", "hin": "hi", "हिन्दी": "hi", "arabic": "ar", "ara": "ar", "العربية": "ar", "thai": "th", "tha": "th", "ไทย": "th", "chinese": "zh", "zho": "zh", "chi": "zh", "中文": "zh", "japanese": "ja", "jpn": "ja", "日本語": "ja", "korean": "ko", "kor": "ko", "한국어": "ko"}
# Abbreviations that can end a sentence, which they do before a capital or an uncased letter.
MAY_END = set("etc inc ltd co corp llc plc jr sr. a.m p.m am pm usw u.s.w ff f uu gmbh ag s.a s.l т.д т.п др г гг руб тыс млн млрд в вв н.э jh esq ph.d b.c a.d".split())
# Of these, the ones that are words of their own unless a number or a letter follows.
_NUMBERED = set("ed eds no nos nr nrn fig figs eq eqs sec secs ch chs vol vols app abs art arts para paras cap kap abb bd pág págs pag núm num max min p pp pg п пп рис табл ст гл стр".split())
_NEVER: dict[str, set[str]] = {}
for _language, _words in NEVER_END.items():
    for _w in set(_words.split()) - MAY_END:
        _NEVER.setdefault(_w, set()).add(_language)
_FREQUENT: dict[str, set[str]] = {}
for _language, _words in FREQUENT.items():
    for _w in _words.split():
        _FREQUENT.setdefault(_w, set()).add(_language)
#: Characters on each side of a word whose frequent words show its language.
NEAR = 100
_LATIN = re.compile("[a-z\u00df-\u024f]")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
# Nouns that take a letter as their label, so that the letter is no initial.
LABELLED = set("plan version option appendix phase type class group part team level case variant table annex exhibit model schedule step tier plans variante klasse teil fall план вариант часть класс".split())
# Small letters that stand for a word, as in z. B., d. h., p. ej. and т. е.
_LETTERS = set("zudsoivmpcnfтекчнпс")
_MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner jan feb apr jun jul aug sep sept okt nov dez".split()
_MONTH = re.compile(rf"\s+(?:{'|'.join(_MONTHS)})\b", re.IGNORECASE)
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u3005\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff]")
_NARROW = set("?!.") | set(ATERM)
_TERMS = set(STERM + ATERM)
_MARKED = STERM + ATERM + chr(34) + "".join(dict.fromkeys([*PAIRS, *_ENDS]))


def _runs_of(least: int, most: int) -> re.Pattern:
    return re.compile(f"[{re.escape(''.join(c for c in _MARKED if least <= ord(c) < most))}]+")


# One set for each width of text: a set with characters beyond the basic plane is searched six times as slowly.
_MARKS, _MARKS_BASIC, _MARKS_ASCII = _runs_of(0, 0x110000), _runs_of(0, 0x10000), _runs_of(0, 0x80)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:([-*+•‣◦●·–])|(\d{1,4})[.)])(?=[ \t]+\S)")
_THAI_GAP = re.compile("(?<=[ก-ฺเ-ๅ็-๎])\\s+(?=[ก-ฮะ-ฺเ-ไ])")
_THAI_LATIN = re.compile("(?<=[ก-ฺเ-ๅ็-๎])\\s+(?=[A-Z][a-z]*\\s[a-z]{2,}\\s[a-z]{2,}|[A-Z][a-z]+\\s[a-z]+\\s)")
_THAI = re.compile("[ก-ฮ]")
_BEFORE = re.compile(r"[^\s()\[\]{}\"'’‘“”„«»/]+\Z")
_GLUED = re.compile(r"[^\W\d_][^\W\d_A-Z]*\s")
_WORD = re.compile(r"\w+\(?")


def language_code(lang: str | None) -> str | None:
    """The code of a language as metadata spell it (``EN``, ``en-US``, ``English``), or null if it is none of the known."""
    head = re.split(r"[-_\s(]", (lang or "").strip().lower(), maxsplit=1)[0]
    head = NAMES.get(head, head)
    return head if head in NEVER_END else None


class Scope:
    """Decides between languages where a word is an abbreviation in some but not in all. Texts mix languages within one
    paragraph, so the frequent words around it come first; where they show nothing or speak for both, the stated language
    decides; where that is unknown, the abbreviation holds. Abbreviations of other scripts have no rival."""

    def __init__(self, text: str, lang: str | None) -> None:
        self.text, self.stated = text, language_code(lang)

    def holds(self, word: str, languages: set[str], lo: int, at: int, hi: int) -> bool:
        if not _LATIN.match(word) or self.stated in languages and len(languages) > 4:
            return True
        counts: dict[str, int] = {}
        for w in _LETTERS_ONLY.findall(self.text[max(lo, at - NEAR) : min(hi, at + NEAR)].lower()):
            for x in _FREQUENT.get(w, ()):
                counts[x] = counts.get(x, 0) + 1
        own = max((n for x, n in counts.items() if x in languages), default=0)
        other = max((n for x, n in counts.items() if x not in languages), default=0)
        if own != other:
            return own > other
        return own > 0 or self.stated is None or self.stated in languages


def _breaks_after_stop(scope: Scope, text: str, lo: int, at: int, end: int, after: int, gap: bool, closed: bool, hi: int) -> bool:
    """Whether the lone full stop text[at] ends a sentence; ``end`` lies behind the marks that close it, ``after`` is the
    next character that is not blank, ``hi`` the end of the paragraph."""
    nxt = text[after]
    if not gap:
        if _UNSPACED.match(nxt) and at > lo and _UNSPACED.match(text[at - 1]):
            return not closed
        prev = text[end - 1] if end - 1 > at else text[at - 1] if at > lo else " "
        # a sentence glued to the next one: small letter, stop, capitalised word of plain letters
        return nxt.isupper() and (prev.islower() or prev.isdigit() or prev in ")%\"”»") and bool(_GLUED.match(text, after, hi)) and _abbreviation(scope, text, lo, at, after, hi) != 1
    if nxt in CONTINUE and nxt not in "-–—":
        return False
    kind = _abbreviation(scope, text, lo, at, after, hi)
    if kind == 1 and not closed:
        return False
    k = after
    while k < hi and (text[k] in _OPENING or text[k] in "¿¡"):
        k += 1
    if k >= hi:
        return True
    c = text[k]
    if c.islower():
        if kind or closed:
            return False
        word = _WORD.match(text, k, hi)[0]
        return any(x.isupper() or x.isdigit() or x in "(_" for x in word)
    if kind == 2 and c.isdigit():
        return False
    return True


def _abbreviation(scope: Scope, text: str, lo: int, at: int, after: int, hi: int) -> int:
    """Of the word before the stop at ``at``: 1 if it is an abbreviation that goes on, 2 if one that may end, else 0."""
    back = 24
    m = _BEFORE.search(text, max(lo, at - back), at)
    while m and m.start() == at - back > lo:  # the word may begin further up
        back *= 4
        m = _BEFORE.search(text, max(lo, at - back), at)
    if not m:
        return 0
    word = m[0].rpartition("-")[2]
    low = word.lower()
    if low in MAY_END:
        return 2
    if low in _NUMBERED:
        return int(text[after].isdigit() or (text[after].isupper() and not text[after + 1 : after + 2].isalnum()) or len(low) == 1)
    if low in _NEVER and scope.holds(low, _NEVER[low], lo, at, hi):
        return 1
    if low.isdigit() and len(low) <= 2 and _MONTH.match(text, at + 1):
        return 1
    letters = low.replace(".", "")
    if "." in low and letters.isalpha() and all(len(x) == 1 for x in low.split(".")):
        return 2 if low in MAY_END else 1
    if len(word) == 1 and word.isalpha():
        end = m.start()
        while end > lo and text[end - 1].isspace():
            end -= 1
        begin = end
        while begin > lo and not text[begin - 1].isspace():
            begin -= 1
        before = text[begin:end].lower()
        if low in "дп" and before == "т.":
            return 2
        if word.isupper() and before in LABELLED:
            return 0
        if _UNSPACED.match(word):
            return 0
        if word.islower() and low not in _LETTERS:
            return int(len(before) == 2 and before[1] == "." and before[0].isalpha())
        return 1
    return 0


def _events(text: str, marked: re.Pattern, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Runs of terminators [from, to), and the places of quotation marks and brackets. Empty brackets, and full stops inside
    of names and numbers, are passed over."""
    runs: list[tuple[int, int]] = []
    pairs: list[int] = []
    for m in marked.finditer(text, lo, hi):
        marks, at = m[0], m.start()
        if marks == "()":
            continue
        if marks == ".":
            if at + 1 >= hi or not ("a" <= text[at + 1] <= "z" or "0" <= text[at + 1] <= "9"):
                runs.append((at, at + 1))
            continue
        k, n = 0, len(marks)
        while k < n:
            c = marks[k]
            if c in _TERMS:
                j = k + 1
                while j < n and marks[j] in _TERMS:
                    j += 1
                runs.append((at + k, at + j))
                k = j
            elif c == "(" and marks[k + 1 : k + 2] == ")":
                k += 2
            else:
                pairs.append(at + k)
                k += 1
    return runs, pairs


def _pairs(places: list[int], text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost spans [first mark, behind the last mark) between matching quotation marks or brackets."""
    stack: list[tuple[str, int]] = []
    still: dict[str, list[int]] = {}  # of each opening mark, its places in the stack
    spans: list[tuple[int, int]] = []
    for at in places:
        c = text[at]
        opening = _ENDS.get(c) if c != '"' else '"'
        found = still[opening][-1] if still.get(opening) else -1
        if found >= 0 and not (c == '"' and _opens(text, at, lo, hi)):
            spans.append((stack[found][1], at + 1))
            while len(stack) > found:
                still[stack.pop()[0]].pop()
        elif c == '"' or c in PAIRS:
            still.setdefault(c, []).append(len(stack))
            stack.append((c, at))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    return outer


def _opens(text: str, at: int, lo: int, hi: int) -> bool:
    """A straight mark that can only open: blank before, none behind."""
    return (at == lo or text[at - 1].isspace()) and at + 1 < hi and not text[at + 1].isspace() and (text[at + 1].isalnum() or text[at + 1] in "¿¡([")


def _paragraph(scope: Scope, text: str, marked: re.Pattern, lo: int, hi: int, body: int, out: list[tuple[int, int]]) -> None:
    """Append the units of text[lo:hi]; marks before ``body`` (a list marker) end nothing."""
    cuts: list[int] = []
    runs, places = _events(text, marked, body, hi)
    spans = _pairs(places, text, lo, hi) if places else []
    starts = [s for s, _ in spans]
    for at, behind in runs:
        run, end = text[at:behind], behind
        k = bisect_right(starts, at) - 1
        limit = spans[k][1] if k >= 0 and at < spans[k][1] else 0
        while end < hi:
            c = text[end]
            if c in _CLOSE and not (c == '"' and limit == 0 and _opens(text, end, lo, hi)) and not (limit == 0 and c in "“" and end + 1 < hi and text[end + 1].isalnum()) and c not in "«„":
                end += 1
            elif limit and c.isspace() and end + 1 < hi and text[end + 1] in "»”\"" and end + 2 == limit:
                end += 2
            else:
                break
        if limit and end < limit:
            continue
        if not limit and end > behind and bisect_right(starts, end - 1) - 1 != k:
            end = behind
        closed = bool(limit)
        after = end
        while after < hi and text[after].isspace():
            after += 1
        if after >= hi:
            continue
        gap = after > end
        nxt = text[after]
        if run == "." or all(c in ATERM or c == "…" for c in run):
            if len(run) > 1 or run == "…":
                ok = gap and not nxt.islower() and nxt not in CONTINUE or (not gap and bool(_UNSPACED.match(nxt)) and not closed and at > lo and bool(_UNSPACED.match(text[at - 1])))
            else:
                ok = _breaks_after_stop(scope, text, lo, at, end, after, gap, closed, hi)
        elif run[-1] in _NARROW:
            if gap:
                ok = nxt not in CONTINUE and not (closed and nxt.islower())
            else:
                ok = not closed and (bool(_UNSPACED.match(nxt)) or (at > lo and bool(_UNSPACED.match(text[at - 1]))) or (nxt.isupper() and bool(_GLUED.match(text, after, hi)))) or nxt in "¿¡"
        else:
            ok = gap and not (closed and nxt.islower()) or (not gap and not closed)
            ok = ok and nxt not in CONTINUE
        if ok:
            cuts.append(end)
    if marked is not _MARKS_ASCII and _THAI.search(text, body, hi):
        for rule in (_THAI_GAP, _THAI_LATIN):
            for m in rule.finditer(text, body, hi):
                k = bisect_right(starts, m.start()) - 1
                if k < 0 or m.start() >= spans[k][1]:
                    cuts.append(m.start())
        cuts.sort()
    for at in (*cuts, hi):
        while lo < at and text[lo].isspace():
            lo += 1
        end = at
        while end > lo and text[end - 1].isspace():
            end -= 1
        if end > lo:
            out.append((lo, end))
        lo = at


def _lines(text: str) -> list[str]:
    if "\r" in text.replace("\r\n", "\n"):
        return re.findall(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+", text)
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines


def sentence_units(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in order, in code points."""
    scope = Scope(text, lang)
    out: list[tuple[int, int]] = []
    marked = _MARKS_ASCII if text.isascii() else _MARKS if _ASTRAL.search(text) else _MARKS_BASIC
    lo = body = -1  # start of the open paragraph and of its text behind a list marker
    hi = 0
    fence = ""
    fence_from = at = 0
    in_list = False

    def strip_to(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    for line in _lines(text):
        start, at = at, at + len(line)
        if fence:
            bare = line.strip()
            if bare.startswith(fence) and not bare.strip(fence[0]):
                strip_to(fence_from, at)
                fence = ""
            continue
        if line.isspace() or not line:
            if lo >= 0:
                _paragraph(scope, text, marked, lo, hi, body, out)
                lo = -1
            in_list = False
            continue
        first = line.lstrip()[0]
        if first in "`~" and (m := _FENCE.match(line)):
            if lo >= 0:
                _paragraph(scope, text, marked, lo, hi, body, out)
                lo = -1
            fence, fence_from = m[1], start
            continue
        if first == "#" and _HEADING.match(line):
            if lo >= 0:
                _paragraph(scope, text, marked, lo, hi, body, out)
                lo = -1
            strip_to(start, at)
            continue
        if (first.isdigit() or not first.isalnum()) and (m := _ITEM.match(line)) and (lo < 0 or in_list or text[lo:hi].rstrip()[-1] in f"{STERM}{ATERM}:："):
            if lo >= 0:
                _paragraph(scope, text, marked, lo, hi, body, out)
            lo, body, in_list = start, start + m.end(), True
        elif lo < 0:
            lo = body = start
        hi = at
    if fence:
        strip_to(fence_from, len(text))
    if lo >= 0:
        _paragraph(scope, text, marked, lo, hi, body, out)
    return out


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, start_char, end_char``: one row for each sentence unit of each document, without outer white space.

    A null or blank text has no units; a row that is repeated counts once. The column ``lang``, where there is one, states the
    language, in whatever spelling; it may be null or wrong. Work and memory follow one text at a time; the
    only shuffle is of the narrow result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for k, t, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if t:
                    for a, b in sentence_units(t, x):
                        keys.append(k)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_char", "end_char"])

    stated = F.col(lang).cast("string") if lang in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), stated.alias("lang")).filter(F.col(text).isNotNull())
    return rows.mapInArrow(run, f"{key} bigint, start_char int, end_char int").distinct()
