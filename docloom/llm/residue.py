"""Records without real content: unfilled templates, filler, error pages and notices.

Placeholders: each kind of delimiter has its own grammar. What stands in fenced or inline code, in mathematics or in the
arguments of a TeX command is masked first, and a placeholder in a sentence that talks about templates, placeholders or
variables is discounted, as is one that is named by an article or quoted, or that stands shortly after words about tutorials
or placeholders.

Filler and notices: a text is divided into units (lines, sentences, fields of a navigation bar). Each unit is a notice,
filler, page chrome (headings, navigation, references of an incident) or other text. A record is found if it has a notice
or filler and other text makes up a small part of its letters: the density that sets a page apart from prose about it. A
single short sentence among nothing but page chrome is a notice too, whatever its words.

Defined results: null texts and texts without letters are no case; code and tutorials are no case; the length of a text
does not matter, all of it is read; repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser as P

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Nouns that the last word of a placeholder in plain words is.
NOUNS = "name date title number address company email city url link value author code text amount phone year place topic department position signature".split()
NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+)*"
GRAMMARS = {
    "double brace": rf"(?<![\\}}_^$]) ?\{{\{{\s*{NAME}(?:\s*\|\s*[A-Za-z_]+(?:\([^(){{}}\n]*\)|:[^{{}}|\n]*)?)*\s*\}}\}}",
    "dollar brace": rf"\$\{{\s*{NAME}(?::-[^{{}}\n]*)?\s*\}}",
    "hash brace": rf"#\{{\s*{NAME}\s*\}}",
    "statement": rf"\{{%-?\s*{NAME}\s*-?%\}}",
    "embedded": rf"<%[=-]?\s*{NAME}\s*-?%>",
    "printf": r"%\([A-Za-z_]\w*\)[sdrf]",
    "underscores": r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    "at signs": rf"@@{NAME}@@",
    "double angle": rf"<<\s*{NAME}\s*>>",
    "angle here": r"<[A-Z][A-Z0-9_ ]* HERE>|<(?:INSERT|ENTER|YOUR)[ _][A-Z0-9_ ]+>",
    "escaped angle": r"&lt;[A-Za-z]+(?:[_ ][A-Za-z]+)*&gt;",
    "double bracket": rf"\[\[\s*{NAME}\s*\]\]",
    "single brace": r"(?<![\\}_^$#{%\w])\{[A-Za-z]+(?:_[A-Za-z]+)*\}(?!\})",
    "words in brace": rf"(?<![\\}}_^$#{{%\w])\{{(?:[a-z]+ ){{1,3}}(?:{'|'.join(NOUNS)})\}}(?!\}})",
    "words in bracket": rf"(?<!\w)\[(?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(n.title() for n in NOUNS)})\](?![(\[:])",
    "percent signs": r"(?<![\w%])%[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*%(?!\w)",
    "insert": r"\[(?:INSERT|ENTER|ADD|TODO:?|TBD:?) [A-Z0-9 _]+\]",
    "your here": r"\[(?:your|insert|enter|add|type) [a-z0-9 _]+(?: here)?\]",
    "to fill in": r"【[^】\n]{1,40}(?:입력|기입|작성|삽입)】|\[[^\]\n]{1,40}(?:입력|기입|작성|삽입)\]",
    "marked": r"(?<!\w)(?:XX|ZZ)_[A-Z][A-Z0-9_]*_(?:XX|ZZ)(?!\w)",
}
GRAMMAR = re.compile("|".join(f"(?:{g})" for g in GRAMMARS.values()))
SIGNS = ("{", "<%", "%(", "__", "@@", "<<", " HERE>", "<INSERT", "<ENTER", "<YOUR", "&lt;", "[[", "[INSERT", "[ENTER", "[ADD", "[TODO", "[TBD")
SIGNS += ("[your", "[insert", "[enter", "[add", "[type", "【", "입력]", "기입]", "작성]", "삽입]", "XX_", "ZZ_")
SIGNS += tuple(f" {n.title()}]" for n in NOUNS)
PERCENT = re.compile(r"%[A-Z][A-Z0-9_]+%")
# Element names of HTML, which are no placeholders when escaped.
TAGS = set("a b i p u em h1 h2 h3 br hr li ol ul td th tr div img sub sup pre code span html head body table title strong script style".split())
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<(code|pre|script|style)\b.*?</\1>", re.S | re.I)
MATH = re.compile(r"\$\$.*?\$\$|(?<![\\\w])\$(?![\s{])[^$\n]{1,300}?(?<!\s)\$(?!\w)|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S)
TEX = re.compile(r"\\[A-Za-z]+\*?(?:\s*\[[^\]]*\])?(?:\{+[^{}]*\}+)+")
ABOUT = re.compile(
    r"placeholder|template|variable|\bsyntax|\bdelimiter|\bmacro|\bmarkup|\bescape|\bregex|\bfield code|\btokens? (?:such|like)|such as|for example|e\.g\.|\bwritten as|"
    r"템플릿|서식|자리에|자리표시|변수|문법|예를 들어|구문|매크로|표기",
    re.I,
)

# What a text says shortly before the placeholders that it explains.
TUTORIAL = re.compile(r"\btutorial|\bplaceholders?\b|\btemplate (?:syntax|engine|language|variable)|자리표시|템플릿 (?:문법|엔진|변수)", re.I)
TUTORIAL_REACH = 400

WORDS_NOTICE = (
    r"\b[45]\d\d\b.{0,40}(?:not found|forbidden|gateway|unavailable|error|denied|unauthori[sz]ed|time-?out|too many)|(?:error|status)(?: code)?:? \d{3}\b|"
    r"(?:page|document|article|paper|file|resource|record|text|content|abstract|translation)s?\b.{0,40}(?:could not|cannot|can't|couldn't) be (?:found|rendered|displayed|loaded|shown|opened|retrieved)|"
    r"(?:page|document|article|paper|file|resource)\b.{0,30}(?:does not exist|no longer (?:exists|available)|has been (?:removed|moved))|"
    r"internal (?:server )?error|could not complete your request|too many requests|session (?:has )?(?:expired|timed out)|(?:sign|log) in (?:again )?to|"
    r"(?:enable|turn on|allow|activate|requires?|needs?) .{0,20}(?:javascript|scripts?\b|scripting|cookies?)|"
    r"(?:javascript|scripting|scripts?|cookies?)(?: and \w+)? (?:is|are|must be|has been|have been|should be) (?:\w+ )?(?:disabled|blocked|required|enabled|accepted|needed|turned off|off)|"
    r"browser (?:does not|doesn't|cannot|is not|is no longer|is out of) |not a robot|you are (?:a )?human|access .{0,40}(?:denied|blocked|restricted|forbidden)|"
    r"(?:do not|don't) have (?:the )?permission|temporarily unavailable|(?:under|down for|scheduled) maintenance|be back (?:soon|shortly)|(?:gateway|request|connection|operation) time-?d? ?-?out|upstream (?:\w+ ){0,3}(?:responded|error|failed|closed|server)|empty (?:body|response)|service (?:is )?(?:suspended|offline|down)|something went wrong|unexpected error|connection .{0,40}(?:lost|refused|timed out|reset)|"
    r"traceback \(most recent|^\w*(?:error|exception): |^file \".*\", line \d|(?:please )?(?:try|retry) (?:again )?(?:later|in \d+)|do not exceed the limit|rate limit|"
    r"if nothing happens|^loading(?:\.\.\.|…)?$|may take a few seconds|no results (?:found|were found)|^0 results|"
    r"(?:unsupported|outdated) browser|(?:invalid|missing|expired) (?:token|link|request|url)|quota (?:exceeded|reached)|captcha|verify (?:that )?you|^(?:forbidden|unauthorized|not found|bad request|access denied)\W*$|"
    r"페이지를 찾을 수 없|권한이 없|자바스크립트를 (?:켜|활성|허용|사용)|스크립트(?:가|를) (?:차단|허용|켜|사용)|(?:서버|내부|시스템|통신|연결) ?오류|잠시 후 다시|쿠키(?:를|가) (?:허용|켜|차단|사용)|"
    r"로그인(?:이 필요|해 주|하셔야|하십시오|하세요)|브라우저.{0,20}지원하지|세션이 만료|접근이 (?:거부|차단|제한)|요청이 너무 많|(?:표시|불러올|열|로드할) 수 없|연결이 끊|서비스.{0,10}(?:점검|중단)"
)
WORDS_FILLER = (
    r"\blorem\b|\bipsum\b|\bipsor\b|\bdolem\b|\baliqor\b|dolor sit|sit amet|consectetur|placeholder text|^replace (?:it|this) with|(?:paragraph|text|content|title|abstract|summary) goes here|"
    r"body copy body|^heading (?:one|two|three)\W*$|click (?:here )?to (?:add|edit|enter)|type your \w+ here|(?:text|content|body|section|abstract).{0,20} to be (?:supplied|added|provided|written|announced)|"
    r"no (?:description|abstract|summary|content|text) (?:has been|was|is) (?:entered|provided|available|added)|^(?:tb[dca]|todo|xxx|n/a|asdf|test)(?:\W+(?:tb[dca]|todo|xxx|n/a|asdf|test))*\W*$|coming soon|under construction|"
    r"(?:본문|내용|번역|자료|페이지).{0,6}준비 ?중|추후 (?:등록|제공|추가|공개|입력)|(?:을|를) 입력(?:하세요|해 주|하십시오)|예시(?:입니다|문입니다| 문장| 텍스트)|등록된 (?:내용|설명)이 없|샘플 (?:텍스트|문장)"
)
WORDS_CHROME = (
    r"^(?:home|papers|terms|about|help|language|menu|search|contact|login|sign in|sign up|register|next|previous|top|close|back|go back|retry|reload|refresh)(?:[\s|>/·]+(?:home|papers|terms|about|help|language|menu|search|contact|login|sign in|sign up))*\W*$|"
    r"^(?:back|return|go) to |^copyright|^©|all rights reserved|^contact (?:support|us|the)|^(?:ref|incident|request|trace|error|ticket|session)\b.{0,12}[\s:#.]*[0-9a-f-]{4,}\W*$|^(?:ref|no)\.?$|^(?:ref\. )?no\. ?[0-9a-f]*$|^[0-9a-f-]{6,40}$|^(?:incident|request id:?|ref\.?(?: no\.?)?)\W*[0-9a-f]*$|"
    r"^문의|^홈 ?>|^(?:홈|목록|상세|도움말|로그인|언어|번역 목록)(?:[\s|>/·]+\S+)*$|^뒤로|^돌아가기|^저작권|^\W*$"
)
# A sentence that tells of notices or filler instead of being one.
PROSE = re.compile(r"\b(?:so we|that say|such as|negatives|crawl\w*|parser|figures?|in section|only (?:to|for)|the model|of the runs|masked|in the style of)\b|\bwe (?:classif|add|use|drop|find|found|observ|report|count|saw|remov|filter|label|treat)", re.I)
UNIT = re.compile(r"(?<=[.!?。])\s+|\n+|\s+[-–|·>]\s+|</?(?:html|head|title|body|p|h[1-6]|div|br|li|ul|center|hr)\b[^>]*>", re.I)
NOTICE, FILLER, CHROME = (re.compile(p, re.I) for p in (WORDS_NOTICE, WORDS_FILLER, WORDS_CHROME))


def alternatives(pattern: str) -> list:
    """The parsed alternatives of a pattern."""
    parsed = list(P.parse(pattern, re.I))
    return parsed[0][1][1] if len(parsed) == 1 and parsed[0][0] is C.BRANCH else [parsed]


def strings_of(part, most: int = 64) -> set[str] | None:
    """All strings that a part of a parsed pattern can match, if they are few; places count as empty."""
    op, arg = part
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.AT:
        return {""}
    if op is C.IN and len(arg) <= 4 and all(x is C.LITERAL for x, _ in arg):
        return {chr(x) for _, x in arg}
    if op is C.SUBPATTERN:
        return joined_strings(arg[3], most)
    if op is C.BRANCH:
        own = [joined_strings(x, most) for x in arg[1]]
        return None if None in own else set().union(*own)
    if op is C.MAX_REPEAT and arg[1] == 1:
        own = joined_strings(arg[2], most)
        return own if own is None or arg[0] else own | {""}
    return None


def joined_strings(parts, most: int) -> set[str] | None:
    out = {""}
    for part in parts:
        own = strings_of(part, most)
        if own is None or len(out) * len(own) > most:
            return None
        out = {x + y for x in out for y in own}
    return out


def needed(parts) -> set[str]:
    """Strings of which every match of a parsed pattern holds at least one; the empty string where none is needed."""
    runs, now = [], {""}
    for op, arg in parts:
        own = strings_of((op, arg))
        if own is not None and len(now) * len(own) <= 64:
            now = {x + y for x in now for y in own}
            continue
        runs.append(now)
        now = own or {""}
        if op is C.BRANCH:
            runs.append(set().union(*map(needed, arg[1])))
        elif op is C.SUBPATTERN:
            runs.append(needed(arg[3]))
        elif op is C.MAX_REPEAT and arg[0]:
            runs.append(needed(arg[2]))
    return max([*runs, now], key=lambda x: min(map(len, x)))


def folded(text: str) -> str:
    """Lower case as patterns without case see it."""
    return (text if text.isascii() else text.replace("ſ", "s").replace("ı", "i").replace("İ", "i")).lower()


# What every notice or filler has at least one of, in lower case, taken from the patterns: texts with none hold neither.
TRIGGERS = set().union(*(needed(x) for p in (WORDS_NOTICE, WORDS_FILLER) for x in alternatives(p)))
TRIGGERS = sorted(t for t in TRIGGERS if not any(x != t and x in t for x in TRIGGERS))
OTHER_SHARE = 0.25


def blank(m: re.Match) -> str:
    return " " * 3 + "\n" * m.group().count("\n")


def placeholders(text: str) -> list[str]:
    """The placeholders in ``text`` that stand where a value belongs."""
    if not any(s in text for s in SIGNS) and not PERCENT.search(text):
        return []
    masked = CODE.sub(blank, text)
    if "\\" in masked or "$" in masked:
        masked = TEX.sub(blank, MATH.sub(blank, masked))
    out = []
    for m in GRAMMAR.finditer(masked):
        found = m.group().strip()
        if found.startswith("&lt;") and found[4:-4].lower() in TAGS:
            continue
        lo = max(masked.rfind("\n", 0, m.start()), masked.rfind(". ", 0, m.start())) + 1
        hi = min((x for x in (masked.find("\n", m.end()), masked.find(". ", m.end())) if x >= 0), default=len(masked))
        around = masked[lo : m.start()] + " " + masked[m.end() : hi]
        quoted = masked[m.start() - 1 : m.start()] in "\"'“‘«「" and masked[m.end() : m.end() + 1] in "\"'”’»」" and m.start() > 0
        if quoted or ABOUT.search(around) or TUTORIAL.search(masked, max(0, m.start() - TUTORIAL_REACH), m.start()):
            continue
        out.append(found)
    return out


def unit_kinds(text: str, triggers: list[str], most_other: float = 1.0) -> dict[str, int]:
    """Letters in units of each kind, and the number of units of other text.

    ``triggers``: those that the text holds; a unit without any of them is neither notice nor filler. The count ends as soon
    as other text is known to make up more than ``most_other`` of the text, which settles that there is no case.
    """
    n = {"notice": 0, "filler": 0, "chrome": 0, "heading": 0, "other": 0, "units": 0}
    if "`" in text or "~~~" in text or "<" in text:
        text = CODE.sub(blank, text)
    enough = most_other * len(text)
    for unit in UNIT.split(text):
        unit = unit.strip(" \t\r*_>-–•[]()") if unit else ""
        if not unit:
            continue
        low = folded(unit)
        hot = any(t in low for t in triggers)
        told = hot and (PROSE.search(unit) or ('"' in unit[1:-1] and unit.count(" ") > 12))
        if hot and not told and FILLER.search(unit):
            kind = "filler"
        elif hot and not told and len(unit) < 160 and NOTICE.search(unit):
            kind = "notice"
        elif len(unit) < 160 and CHROME.search(unit):
            kind = "chrome"
        else:
            kind = "heading" if unit.startswith("#") and len(unit) < 40 else "other"
        n[kind] += sum(map(str.isalnum, unit))
        n["units"] += kind == "other"
        if n["other"] > enough and n["other"] > 120:
            break
    return n


def residue_kind(text: str | None) -> str | None:
    """'template', 'filler' or 'notice' for a record without real content, otherwise None."""
    if not text:
        return None
    if placeholders(text):
        return "template"
    low = folded(text)
    triggers = [t for t in TRIGGERS if t in low]
    # without notice and filler only a sentence among chrome can be a case
    n = unit_kinds(text, triggers, OTHER_SHARE if triggers else 0.0)
    bad = n["notice"] + n["filler"]
    if not bad and n["chrome"] >= 6 and n["units"] <= 2 and n["other"] <= 120:
        return "notice"  # a sentence alone among a site's navigation, in whatever words
    if not bad or n["other"] > OTHER_SHARE * (bad + n["chrome"] + n["heading"] + n["other"]):
        return None
    return "notice" if n["notice"] >= n["filler"] else "filler"


def find_residue(df: DataFrame, text: str, output: str = "residue_kind") -> DataFrame:
    """``df`` with the column ``output``: the kind of residue, or null for real content."""

    @F.pandas_udf("string")
    def kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([residue_kind(t) for t in texts], dtype="object")

    return df.withColumn(output, kind(F.col(text).cast("string")))
