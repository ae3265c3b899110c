"""Broken prompt and response pairs (problem 5).

A run has at most one defect, the first of these that holds:

* ``empty``: nothing remains of the answer without white space, invisible characters, punctuation and empty markup,
* ``copied``: greedy string tiling covers the answer with tiles of its prompt, but for a label, and tiles most of the prompt,
* ``refusal``: a grammar of refusals, courtesies and referrals in four languages derives the whole answer, with a refusal in it,
* ``truncated``: a pushdown parser of fences, inline code, brackets, quotations, lists and markup ends within an open
  construct, or within an unfinished sentence of running text,
* ``wrong_language``: script or function words (of eight languages) of the prose are those of another language than the prompt's, and not of one
  that the prompt asks for.

Null answers are empty; a null prompt can't be copied and has no language. Repeated runs count once, by ``request_id`` (the
latest ingested row); rows without one are left out. The check is a narrow map over the runs. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EMPTY_FENCE = re.compile(r"```[\w+-]*\s*```|~~~[\w+-]*\s*~~~")
_TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|&(?:nbsp|zwnj|zwj|#\d+);|<!--.*?-->", re.S)
_WORDS = re.compile(r"\w+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = _TAG.sub("", _EMPTY_FENCE.sub("", answer))
    return not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" for c in t)


# --- copies -----------------------------------------------------------------------------------------------------------


def tiles(answer: list[str], prompt: list[str], least: int = 3) -> tuple[int, int]:
    """Greedy string tiling: tokens of the answer, and of the prompt, within tiles of at least ``least`` tokens.

    The longest match of untiled answer tokens is tiled first. Tiles of the answer don't overlap; the prompt may be used
    again, as repetition is copying too. Time grows with the texts' lengths, as matches are found by a suffix automaton."""
    link, step, longest, first = [-1], [{}], [0], [-1]  # suffix automaton of the prompt, with the first end of each state
    last = 0
    for k, w in enumerate(prompt):
        new = len(link)
        link.append(0), step.append({}), longest.append(k + 1), first.append(k)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if longest[q] > longest[p] + 1:
                copy = len(link)
                link.append(link[q]), step.append(dict(step[q])), longest.append(longest[p] + 1), first.append(first[q])
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    longest_at, at, n, begin = [0] * len(answer), 0, 0, 0  # of each answer token, the longest match from there on
    for end, w in enumerate(answer):
        while at and w not in step[at]:
            at = link[at]
            n = longest[at]
        if w in step[at]:
            at, n = step[at][w], n + 1
        while begin <= end - n:
            longest_at[begin] = end - begin
            begin += 1
    for k in range(begin, len(answer)):
        longest_at[k] = len(answer) - k
    free, used, taken = [True] * len(answer), [False] * len(prompt), [len(answer)]
    heap = [(-n, i) for i, n in enumerate(longest_at) if n >= least]
    heapq.heapify(heap)
    while heap:
        n, i = -heap[0][0], heap[0][1]
        now = min(n, taken[bisect.bisect_left(taken, i)] - i) if free[i] else 0
        if now < least:
            heapq.heappop(heap)
        elif now < n:
            heapq.heapreplace(heap, (-now, i))
        else:
            heapq.heappop(heap)
            bisect.insort(taken, i)
            state = 0
            for k in range(i, i + n):
                free[k] = False
                state = step[state][answer[k]]
            used[first[state] - n + 1 : first[state] + 1] = [True] * n
    return len(answer) - sum(free), sum(used)


def is_copied(prompt: str | None, answer: str) -> bool:
    """Nothing but the prompt again; case, punctuation, spacing, quotes, repetition and a label of up to three words aside."""
    a, p = _WORDS.findall(answer.casefold()), _WORDS.findall((prompt or "").casefold())
    if not a or not p:
        return False
    least = min(3, len(p))
    if len(a) < 0.6 * len(p):
        return False
    grams = {tuple(p[j : j + least]) for j in range(len(p) - least + 1)}
    hit = [False] * len(a)
    for i in range(len(a) - least + 1):
        if tuple(a[i : i + least]) in grams:
            hit[i : i + least] = [True] * least
    room = 3 + len(a) // 50
    if len(a) - sum(hit) > room:  # tiles consist of such matches, so they can't cover more
        return False
    of_answer, of_prompt = tiles(a, p, least)
    return len(a) - of_answer <= room and of_answer >= 0.6 * len(a) and of_prompt >= 0.6 * len(p)


# --- refusals ---------------------------------------------------------------------------------------------------------

_I, _AP = r"(?:i|we)", "['’]"
_CANT = rf"(?:(?:am|are) (?:unable|not able|not allowed|not permitted) to|{_AP}?m (?:unable|not able|not allowed|not permitted) to|can{_AP}?t|can ?not|could not|won{_AP}?t(?: be able to)?|will not(?: be able to)?|must not|may not|have to (?:decline|refuse)|must (?:decline|refuse)|decline|refuse|(?:would|{_AP}d) rather not|do(?:n{_AP}t| not) (?:have permission|feel able) to)"
_DO = r"(?:help|assist|answer|respond|reply|provide|produce|comply|do|take part|discuss|share|support|give|write|fulfil|continue|go into|engage|offer|complete)"
#: A sentence that declines, by language (patterns are matched against whole sentences).
REFUSALS = [
    rf"(?:(?:i{_AP}?m|i am|we are) (?:very |so |really )?sorry|sorry|apologies|my apologies|unfortunately|regrettably)?,? ?(?:but )?(?:as an? [\w -]{{3,40}}?,? )?(?:unfortunately,? )?{_I} ?(?:simply |really |therefore )?{_CANT}(?: \w+)?(?: {_DO}\b.{{0,80}})?",
    rf"(?:i{_AP}?m|i am) (?:sorry|afraid).{{0,20}}(?:not (?:something|possible)|{_CANT}).{{0,60}}",
    r"(?:sorry,? )?(?:this is |that is |that's )?not something (?:i|we) can (?:do|help with|answer)",
    r"no answer can be given(?: here)?",
    rf"(?:that|this|it) (?:falls|is|lies|goes) (?:outside|beyond|out of) (?:of )?(?:what|the scope|my).{{0,60}}",
    r"(?:my|our) (?:guidelines|rules|instructions|policies|policy) (?:do|does) not (?:allow|permit|let) (?:me|us)(?: to)? .{0,60}",
    r"(?:unfortunately,? )?(?:this|that) is something (?:i|we) (?:have to|must|need to) (?:decline|refuse|pass on)",
    r"(?:es )?tut mir (?:sehr )?leid,? .{0,20}(?:kann|darf|werde) ich (?:dir |ihnen |euch )?(?:\w+ )?(?:nicht|keine?) ?.{0,50}",
    r"(?:leider )?(?:diese|die|deine|ihre) (?:anfrage|bitte|frage|aufgabe) (?:muss|kann|darf|möchte) ich (?:leider )?(?:nicht |ablehnen).{0,50}",
    r"(?:leider )?(?:ich |dazu |dabei |hierzu |hierbei |damit |darauf )(?:kann|darf|möchte|werde) (?:ich )?(?:dir |ihnen )?(?:leider )?(?:keine? auskunft|keine antwort|nicht|keine).{0,50}",
    r"(?:désolée?|je regrette|je suis désolée?),? .{0,20}je ne (?:peux|puis|suis) pas .{0,60}",
    r"(?:malheureusement,? )?je (?:ne (?:peux|puis|suis|souhaite) (?:malheureusement )?pas .{0,60}|(?:dois|suis obligée? de) (?:malheureusement )?(?:refuser|décliner).{0,40})",
    r"il ne m['’]est pas (?:permis|possible) de .{0,60}",
    r"(?:lo siento|perdón|lamentablemente|por desgracia),? .{0,20}no (?:puedo|podemos|me es posible) .{0,60}",
    r"(?:lamentablemente,? )?(?:no (?:puedo|me está permitido|me es posible|se me permite|estoy autorizado a) .{0,60}|(?:debo|tengo que) (?:rechazar|declinar).{0,40})",
]
#: A sentence that may accompany a refusal and answers nothing itself.
COURTESIES = [
    r"(?:thank you|thanks)(?: very much| so much)?(?: for (?:the|your|this) .{0,60})?", r"i (?:do )?(?:hope|trust) (?:you|that you) understand.{0,20}", r"thanks? (?:you )?for (?:your )?understanding",
    r"(?:please )?(?:let me know|tell me) if (?:there is|you have|i can).{0,70}", r"(?:please|perhaps|maybe) .{0,15}(?:ask|contact|consult|reach out|turn to|a colleague|someone|somebody|check with).{0,70}",
    r"(?:the|this|your) (?:request|question|topic|material) (?:touches|concerns|involves|asks for|relates to|goes).{0,70}", r"it would not be (?:appropriate|right|proper).{0,60}", r"(?:i (?:am|'m) )?sorry(?: about that| for that| for the inconvenience)?", r"i apologi[sz]e.{0,40}",
    r"(?:danke|vielen dank).{0,60}", r"ich hoffe auf (?:dein|ihr|euer) verständnis", r"bitte (?:wende|wenden|frag|frage|kontaktier).{0,70}", r"(?:es )?tut mir leid",
    r"merci.{0,60}", r"(?:veuillez|adressez[- ]vous|consultez|je vous invite).{0,70}", r"désolée?",
    r"gracias.{0,60}", r"espero que lo (?:entiendas|entienda|comprendas|comprenda)", r"(?:por favor,? )?(?:consulta|consulte|pregunta a|contacta|dirígete).{0,60}", r"lo siento",
]
_REFUSAL = re.compile("(?:" + "|".join(REFUSALS) + r")[\s.!]*", re.I)
_COURTESY = re.compile("(?:" + "|".join(COURTESIES) + r")[\s.!]*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'’”)]*\s+|\n+")
_INLINE = re.compile(r"`[^`\n]*`")


def is_refusal(answer: str) -> bool:
    """Every sentence is derived by the grammar and at least one of them declines."""
    if "```" in answer:
        return False
    declined = False
    text, start = _INLINE.sub("it", answer.strip()), 0
    while start <= len(text):
        m = _SENTENCE.search(text, start)
        s = text[start : m.start() if m else len(text)].strip("-*•# \t")
        start = m.end() if m else len(text) + 1
        if not s:
            continue
        if _REFUSAL.fullmatch(s):
            declined = True
        elif not _COURTESY.fullmatch(s):
            return False
    return declined


# --- truncation -------------------------------------------------------------------------------------------------------

_PUSHDOWN = re.compile(r"(?P<fence>^[ \t]*(?:```|~~~)[^\n`]*$|```)|(?P<code>``?)|(?P<tag></?[A-Za-z][\w-]*>)|(?P<open>[(\[{„“«])|(?P<close>[)\]}”»])|(?P<quote>\")|(?P<item>^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+)|(?P<mark>^[ \t]*(?:#{1,6} |> ?|\|))|(?P<line>\n)|(?P<end>[.!?…。！？]+)|(?P<word>[^\W_]+)|(?P<other>[^\s])", re.M)
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_CODE_END = re.compile(r"[;{}]\s*$|^\s*(?:return\b|[\w.]+\(.*\)$|\w+ :?= )")


def is_truncated(answer: str) -> bool:
    """Whether the pushdown parse of an answer ends with something open that running text would have closed."""
    stack: list[str] = []
    finished, words, prose_words, block, last = True, 0, 0, "prose", ""
    fenced = False
    for m in _PUSHDOWN.finditer(answer):
        kind, t = m.lastgroup, m.group()
        if fenced:
            if kind == "fence":
                fenced, finished, block, words = False, True, "code", 0
            continue
        if stack and stack[-1] == "`":
            if kind == "code":
                stack.pop()
                words += 1
            elif kind == "line":  # inline code ends with its line; it was a stray mark
                stack.pop()
            continue
        if kind == "fence":
            fenced, stack, finished = True, [], True
        elif kind == "code":
            stack.append("`")
            if words == 0 and block != "item":
                block = "prose" if block == "code" else block
            finished = False
        elif kind == "open":
            stack.append("“" if t == "„" else t)
        elif kind == "close":
            if t in _PAIRS and _PAIRS[t] in stack:
                while stack.pop() != _PAIRS[t]:
                    pass
        elif kind == "quote":
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(t)
        elif kind == "tag":
            if t[1] != "/":
                stack.append(t[1:-1].lower())
            elif t[2:-1].lower() in stack:
                while stack.pop() != t[2:-1].lower():
                    pass
        elif kind == "item":
            block, words, finished, stack = "item", 0, True, []
        elif kind == "mark":
            block, words, finished, stack = "mark", 0, True, []
        elif kind == "line":
            if last == "line":  # a blank line ends a block and whatever was open in it
                block, words, stack, finished = "prose", 0, [], True
        elif kind == "end":
            finished = True
        elif kind == "word":
            if block in ("code",):
                block = "prose"
            words += 1
            prose_words += block == "prose"
            finished = False
        last = kind
    if fenced:
        return True
    tail = answer.rstrip()
    if stack and stack[-1] == "`":
        return True
    if block in ("item", "mark"):
        return bool(stack) and not finished
    if finished and not stack or block == "code" and words == 0:
        return False
    if not finished:
        line = tail.rsplit("\n", 1)[-1]
        if _CODE_END.search(line) and prose_words < 4:
            return False
        if prose_words + words <= 3 and not _SENTENCE.search(tail) and not stack:  # a name or a number is a short answer
            return False
        return words > 0
    return False


# --- language ---------------------------------------------------------------------------------------------------------

#: Function words of eight languages; one that several share counts as a share of each (fixed values).
FUNCTION_WORDS = {
    "en": "the and of to is are was were that this these which with without for from by on at as it its be been has have had not but or if then when while what where who how why because before after there their they you your we our can could should would must may do does did into than only until each both most one two all any another yet still nothing nobody whoever please unlike whether",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren wird werden wurde wurden hat haben hatte mit ohne für von vom zum zur auf aus bei nach vor über unter zwischen dass weil wenn sonst noch nur auch als wie warum welche welcher welches wir ihr sie es ich du man bitte zuerst danach bevor jede jedes jeder alle etwas mehr seit davon beim im am",
    "es": "el los las una unos unas y o pero no es son era fue se su sus con sin para por del al que como cuando donde cuál cuántas qué porque si más ya todavía sólo solo hay desde hasta entre sobre cada todo todos nos nadie puede pueden conviene antes después tras lo esto esta este eso cómo ",
    "fr": "le les des du une et ou mais ne pas est sont était sur avec sans pour par dans au aux que qui quoi comme quand où pourquoi parce si plus déjà encore toujours il elle on nous vous ils elles ce cette ces cet son sa ses leur chaque tout tous toutes personne peut peuvent depuis avant après d'abord reste sait fait quel quelle quels quelles du comment",
    "it": "gli della delle degli dello nella nel che di è sono perché anche più questo questa quando dove non ma senza ogni dopo prima",
    "pt": "não uma os das dos ao com para porque também mais isso são foi pelo pela seu sua você onde já até",
    "nl": "het een van dat niet met voor zijn wordt worden maar ook naar bij deze dit als waar geen uit door",
    "pl": "nie się jest że na do tego który która które jak ale tylko przez jego czy oraz gdy już",
}
_LANGUAGE_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGE_OF.setdefault(_w, []).append(_lang)
_LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "èêçàùœîôûâë"}
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|^\s*>.*$|\s>\s.*$|\"[^\"\n]*\"|https?://\S+|\b\w*(?:[a-z][A-Z]|_)\w*\b", re.S | re.M)
_PROSE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_REQUEST = re.compile(
    r"(?:reply|answer|respond|write|explain|response|output|translat\w*)\b[^.?!\n]{0,40}\b(?:in|into|to)\s+(english|german|french|spanish|italian|portuguese|dutch|polish)"
    r"|(?:antwort\w*|schreib\w*|erklär\w*|übersetz\w*|formulier\w*)\b[^.?!\n]{0,40}\b(?:auf|ins?)\s+(englisch\w*|deutsch\w*|französisch\w*|spanisch\w*)"
    r"|(?:respond\w*|contest\w*|escrib\w*|explic\w*|traduc\w*)\b[^.?!\n]{0,40}\b(?:en|al)\s+(inglés|alemán|francés|español)"
    r"|(?:répond\w*|écri\w*|expliqu\w*|traduis\w*|traduire)\b[^.?!\n]{0,40}\b(?:en)\s+(anglais|allemand|français|espagnol)",
    re.I,
)
_LATIN, _ASCII = re.compile(r"[A-Za-z]+"), re.compile(r"[\x00-\x7f]+")
_NAMES = {"en": ("engl", "ingl", "angl"), "de": ("germ", "deut", "alem", "alle"), "fr": ("fren", "fran"), "es": ("span", "espa"), "it": ("ital",), "pt": ("port",), "nl": ("dutc",), "pl": ("poli",)}


def script_of(text: str) -> str:
    """The script most letters are of: latin, or the first word of their Unicode name."""
    latin = len(text) - len(_LATIN.sub("", text))
    if text.isascii():
        return "latin" if latin else ""
    seen = Counter("latin" if c < "ɐ" else unicodedata.name(c, "?").split()[0].lower() for c in _ASCII.sub("", text) if c.isalpha())
    seen["latin"] += latin
    script, n = seen.most_common(1)[0]
    return script if n else ""


def language(prose: str) -> str | None:
    """The language of a prose by its function words and letters, null when they don't tell."""
    score, low = dict.fromkeys(FUNCTION_WORDS, 0.0), prose.lower()
    for w, n in Counter(_PROSE.findall(low)).items():
        langs = _LANGUAGE_OF.get(w, ())
        for x in langs:
            score[x] += n / len(langs)
    if not low.isascii():
        for x, letters in _LETTERS.items():
            score[x] += 0.5 * sum(map(low.count, letters))
    b, a = sorted(score.values())[-2:]
    return min(x for x, v in score.items() if v == a) if a >= 2 and a >= 1.5 * b else None


def is_wrong_language(prompt: str | None, answer: str) -> bool:
    if not prompt:
        return False
    prose, asking = _CODE.sub(" ", answer), _CODE.sub(" ", prompt)
    want, got = script_of(asking), script_of(prose)
    if want and got and want != got:
        return len(_PROSE.findall(prose)) >= 3 and not _REQUEST.search(prompt)
    of_answer = language(prose)
    of_prompt = language(asking) if of_answer else None
    if of_prompt is None or of_prompt == of_answer:
        return False
    asked = {x for m in _REQUEST.finditer(prompt) for g in m.groups() if g for x, starts in _NAMES.items() if g.lower().startswith(starts)}
    return of_answer not in asked


def defect(prompt: str | None, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_copied(prompt, answer):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    return "wrong_language" if is_wrong_language(prompt, answer) else None


def check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [defect(p, a) for p, a in zip(b.column("prompt").to_pylist(), b.column("artifact_content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array(found, pa.string()), b.column("t")], ["request_id", "defect", "t"])


def check(runs: DataFrame) -> DataFrame:
    """``request_id, defect`` of every run, the defect null for a usable answer."""
    time = F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("t")
    checked = runs.filter("request_id is not null").select("request_id", "prompt", "artifact_content", time).mapInArrow(check_batches, "request_id string, defect string, t timestamp")
    return checked.groupBy("request_id").agg(F.max_by(F.struct("defect"), "t").alias("d")).select("request_id", "d.defect")


def found(runs: DataFrame) -> DataFrame:
    return check(runs).filter("defect is not null")


def rates(runs: DataFrame) -> DataFrame:
    """Runs and shares of each defect; null is a usable answer."""
    n = check(runs).groupBy("defect").agg(F.count("*").alias("runs"))
    return n.select("defect", "runs", F.round(F.col("runs") / F.sum("runs").over(Window.partitionBy()), 6).alias("share"))
