"""Sentence boundaries across languages and scripts (problem 10).

A pushdown automaton walks the punctuation events of a text.  Its stack holds open quotations and brackets (with the
fact whether a colon introduced them) and list levels (with the label of their last item, so a label counts as one only
where it begins or continues a level); abbreviations are recognised by a trie over reversed words; terminators are
chosen by script.  It emits code-point offsets.  The automaton only visits punctuation, so letters cost nothing but
the scan of one compiled pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .arrowio import flat_map, table

# Abbreviations by behaviour.
# Never the end of a sentence: titles and particles that need a following word.
TITLES = "mr mrs ms dr prof capt col gen lt sgt rev st hr fr frl sr sra srta mme mlle д-р г-н г-жа डॉ श्री ca bzw vgl i.e e.g c.-à-d p.ex cf viz"
# Need a number after them.
NUMBERED = "no nr núm num vol p pp art fig ch chap nos стр с рис"
# May end a sentence: decided by what follows.
CLOSING = "etc a.m p.m h usw ltd inc co jr bros др"
# Month names after which "3." is an ordinal.
MONTHS = (
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre"
)

_NEVER, _NUM, _MAY = 1, 2, 3
_MONTHS = frozenset(MONTHS.split())


def _build_trie() -> dict:
    trie: dict = {}
    for kind, words in ((_NEVER, TITLES), (_NUM, NUMBERED), (_MAY, CLOSING)):
        for word in words.split():
            node = trie
            for ch in reversed(word):
                node = node.setdefault(ch, {})
            node[""] = kind
    return trie


_TRIE = _build_trie()

_STRONG = "。！？।॥｡"
_EVENT = re.compile(r"\n[^\S\n]*\n\s*|[.!?…。！？।॥؟｡]+|[«»“”„「」『』\"()\[\]（）]")
#: The label of a list item at the beginning of a line: its numbers ("2", "1.3") or letter, closed by a dot or bracket.
_LABEL = re.compile(r"^[^\S\n]*(?:((?:\d{1,3}\.)*\d{1,3})|([A-Za-z]))[.)](?=[^\S\n])", re.M)
_BREAK = re.compile(r"\n[^\S\n]*\n")
_OPEN = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）"}
_CLOSE = frozenset("»”」』)]）")
_BRACKETS = {"(": ")", "[": "]", "（": "）"}
_ANY_BRACKET = re.compile(r"[()\[\]（）]")
_LIST = "1"
_THAI = re.compile(r"[฀-๿]")
_THAI_CUT = re.compile(r"\n[^\S\n]*\n\s*|(?<![0-9๐-๙\s])[^\S\n]+(?![0-9๐-๙\s])")
_CLOCK_OPENER = re.compile(r"\W*\w{1,3}\s+\d{1,2}(?:[:.]\d\d)?\s*\Z")
_NAME = re.compile(r"\w+")


def is_thai(text: str) -> bool:
    """More than half of the letters and marks are Thai."""
    thai = len(_THAI.findall(text))
    return thai > 0 and 2 * thai > sum(map(str.isalpha, text)) + 0.4 * thai


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


def _abbreviation(text: str, dot: int) -> int:
    """Kind of the abbreviation that the dot at ``dot`` closes, 0 if none."""
    node, i, found = _TRIE, dot - 1, 0
    while i >= 0:
        node = node.get(text[i].lower())
        if node is None:
            break
        if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in ".-")):
            found = node[""]
        i -= 1
    if found:
        return found
    c = text[dot - 1] if dot else ""
    if c.isalpha() and not _caseless(c) and (dot < 2 or not (text[dot - 2].isalnum() or text[dot - 2] in "'’")):
        return _NEVER
    return 0


def _opens(text: str, i: int, n: int) -> bool:
    """A straight quotation mark at i opens rather than closes."""
    before = i == 0 or text[i - 1].isspace() or text[i - 1] in "([—–-:"
    return before and i + 1 < n and not text[i + 1].isspace()


def _ordinal(text: str, dot: int, nxt: int) -> bool:
    i = dot
    while i > 0 and text[i - 1].isdigit():
        i -= 1
    if i == dot or dot - i > 2:
        return False
    m = _NAME.match(text, nxt)
    return bool(m) and m.group().lower() in _MONTHS


def _closed_brackets(text: str, start: int) -> set[int]:
    """Places of the opening brackets that are closed within their paragraph; the others suspend no sentence end."""
    closed: set[int] = set()
    stack: list[int] = []
    breaks = [m.start() for m in _BREAK.finditer(text, start)]
    b = 0
    for m in _ANY_BRACKET.finditer(text, start):
        i = m.start()
        while b < len(breaks) and breaks[b] < i:
            stack.clear()
            b += 1
        if text[i] in _BRACKETS:
            stack.append(i)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if _BRACKETS[text[stack[k]]] == text[i]:
                    closed.add(stack[k])
                    del stack[k:]
                    break
    return closed


def _list_labels(text: str, start: int) -> dict[int, tuple[tuple[int, ...], int]]:
    """Labels at line beginnings by the place of their closing mark: (numbers, a letter's negative), indentation."""
    out = {}
    for m in _LABEL.finditer(text, start):
        label = tuple(map(int, m.group(1).split("."))) if m.group(1) else (-1 - (ord(m.group(2).lower()) - 97),)
        out[m.end() - 1] = label, m.start()
    return out


def _continues(stack: list[tuple], label: tuple[int, ...], fresh: bool) -> bool:
    """The label goes on with an open list level (inner ones end then) or, where a sentence begins, opens one.  Changes
    the stack accordingly."""
    step = -1 if label[-1] < 0 else 1
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] != _LIST:
            return False
        last = stack[k][1]
        if len(last) == len(label) and last[:-1] == label[:-1] and last[-1] + step == label[-1]:
            del stack[k:]
            stack.append((_LIST, label, -1))
            return True
    if fresh and label[-1] in (1, -1):
        stack.append((_LIST, label, -1))
        return True
    return False


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``; null and blank texts have none."""
    if not text or text.isspace():
        return []
    n = len(text)
    out: list[tuple[int, int]] = []
    start = n - len(text.lstrip())
    if _THAI.search(text) and is_thai(text):
        for m in _THAI_CUT.finditer(text, start):
            if m.start() > start:
                out.append((start, m.start()))
            start = m.end()
        if start < n:
            out.append((start, start + len(text[start:].rstrip())))
        return [s for s in out if s[1] > s[0]]

    stack: list[tuple] = []  # (mark, whether a colon introduced it, place) or (list, label of its last item, -1)
    closed_brackets = _closed_brackets(text, start) if _ANY_BRACKET.search(text, start) else ()
    labels = _list_labels(text, start) if "\n" in text or _LABEL.match(text, start) else {}
    items = {line + len(text[line:i]) - len(text[line:i].lstrip()): label for i, (label, line) in labels.items()}
    pos = start
    for m in _EVENT.finditer(text, start):
        i = m.start()
        if i < pos:
            continue
        c = text[i]
        if i in labels:
            label, line = labels[i]
            b = line
            while b > start and text[b - 1].isspace():
                b -= 1
            fresh = line <= start or text[b - 1] in ":：;；,，"
            if _continues(stack, label, fresh):
                pos = i + 1
                continue
        if c == "\n":
            if i > start:
                out.append((start, i))
            start = pos = m.end()
            stack.clear()
            continue
        if c in '"«“„「『([（':
            if c == "“" and stack and stack[-1][0] == "„":
                stack.pop()
            elif c in _BRACKETS and i not in closed_brackets:
                continue
            elif c != '"' or _opens(text, i, n):
                b = i
                while b > start and text[b - 1].isspace():
                    b -= 1
                stack.append((c, b > start and text[b - 1] in ":：", i))
            elif stack and stack[-1][0] != _LIST:
                stack.pop()
            continue
        if c in _CLOSE:
            if stack and stack[-1][0] != _LIST:
                stack.pop()
            continue

        # a terminator
        j = m.end()
        if stack and stack[-1][0] in _BRACKETS:
            continue
        strong = text[j - 1] in _STRONG
        single_dot = c == "." and j == i + 1
        kind = 0
        if single_dot:
            if j < n and (text[j].isalnum() or text[j] in "-,;"):
                continue
            kind = _abbreviation(text, i)
        k, closed, colon, opened_at = j, False, False, -1
        while k < n:
            ch = text[k]
            if ch in _CLOSE or (ch == "“" and stack and stack[-1][0] == "„") or (ch == '"' and not _opens(text, k, n)):
                step = 1
            elif ch.isspace() and k + 1 < n and text[k + 1] == "»":
                step = 2
            else:
                break
            closed = closed or ch not in ")]）"
            k += step
            if stack and stack[-1][0] != _LIST:
                _, colon, opened_at = stack.pop()
        if k >= n:
            pos = n
            continue
        nc = text[k]
        if nc in ",;:，；：":
            pos = k
            continue
        w = k
        while w < n and text[w].isspace():
            w += 1
        if w >= n:
            pos = n
            continue
        if w == k and not strong and not _caseless(nc) and nc.isalnum():
            continue
        nx = text[w]
        blank_line = text.count("\n", k, w) > 1
        if blank_line or (w in items and _continues(stack[:], items[w], False)):
            ends = True
        elif closed:
            if nx in "—–-":
                d = w + 1
                while d < n and text[d].isspace():
                    d += 1
                ends = not (d < n and text[d].islower())
            elif nx.islower():
                ends = False
            elif _caseless(nx):
                ends = colon
            else:
                # a quotation and its attribution both in capitals
                ends = not (
                    nx.isupper() and w + 1 < n and text[w + 1].isupper() and i > 0 and opened_at >= 0
                    and text[opened_at:i].isupper() and not colon
                )
        elif nx.islower():
            ends = False
        elif single_dot and kind:
            if kind == _NEVER:
                ends = False
            elif kind == _NUM:
                ends = not nx.isdigit()
            else:
                d = i
                while d > start and not text[d - 1].isspace():
                    d -= 1
                ends = not _CLOCK_OPENER.match(text[start:d])
        elif single_dot and text[i - 1 : i].isdigit():
            # an ordinal, or the number of a list item
            ends = not (_ordinal(text, i, w) or text[start:i].strip().isdigit())
        else:
            ends = True
        if ends:
            out.append((start, k))
            start = pos = w
        else:
            pos = k
    if start < n:
        end = start + len(text[start:].rstrip())
        if end > start:
            out.append((start, end))
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, sent_start, sent_end) per sentence of ``df[text]``.

    Null, empty and blank texts give no row; repeated rows give repeated sentences; other columns are ignored.  The
    plan is one scan of two columns and one narrow Arrow stage, without a shuffle.
    """
    key_type = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("k"), df[text].alias("t")).where("t is not null")

    def rows(k, t):
        return [(k, a, b) for a, b in sentence_spans(t)]

    return flat_map(picked, rows, f"{key} {key_type}, sent_start int, sent_end int")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "sent_start")
