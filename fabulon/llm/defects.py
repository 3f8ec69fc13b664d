"""Broken prompt and response pairs (problem 2).

Each answer is parsed once: a pushdown parser over fences, brackets, quotations, lists and markup tells how it ends
(with the end model of problem 7 for the last context), greedy string tiling measures how much of the prompt it gives
back, trigrams learned from the corpus' labelled texts tell its language, and a grammar finds refusals outside quoted
speech.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowio import table
from .encoding import ChainModel, chapter_model, repair
from .languages import Languages, fit_languages, label
from .refusals import is_refusal
from .repetition import words_of
from .sentences import sentence_spans
from .truncation import MARGIN, EndModel, corpus, fit_ends, is_closed, tail, text_odds, with_odds

# Names of languages in requests.
LANGUAGE_NAMES = {
    "en": "english anglais anglaise inglés englisch", "fr": "french français française francés französisch",
    "de": "german allemand allemande deutsch alemán", "es": "spanish espagnol espagnole español spanisch",
    "ru": "russian russe", "zh": "chinese chinois", "ja": "japanese japonais", "hi": "hindi", "th": "thai thaï",
    "it": "italian italien italienne", "pt": "portuguese portugais",
}
# Requests to give the text back unchanged.
REPEAT = r"\b(?:repeat|copy|echo|retype|reproduce|say again|write out|recop\w+|répét\w+|reproduis\w*|word for word|verbatim|mot pour mot|mot à mot|wiederhol\w+|repit\w+)\b"

_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}
_NAME = re.compile(r"\b(" + "|".join(_NAMES) + r")\b", re.I)
_REPEAT = re.compile(REPEAT, re.I)
_VISIBLE = re.compile(r"[^\W_]|[!-/:-@\[-`{-~¡-¬®-¿‐-‧‰-⁞、-〿]")
_LEAD_IN = re.compile(r"\A[^\n]*:\s*\n+|\A[^\n:.!?]*:\s+")
_ITEM = re.compile(r"^([^\S\n]*)(?:[-*•+]|\d{1,3}[.)]|[A-Za-z][.)])[^\S\n]+", re.M)
_MARKUP = re.compile(r"```|~~~|\*\*|__|</?[A-Za-z][\w-]*[^<>]*>|[()\[\]{}]|[«»“”„\"「」]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "「": "」"}
#: Shortest tile in words, and the coverage of both sides from which an answer gives its prompt back.
TILE, COPY_ANSWER, COPY_PROMPT = 4, 0.8, 0.7
#: The same in characters, for answers that share at least the part ``SHARED`` of their words with the prompt.
CHAR_TILE, CHARS_ANSWER, CHARS_PROMPT, SHARED = 6, 0.7, 0.6, 0.4


def open_constructs(text: str) -> list[str]:
    """What a pushdown parser leaves open at the end: fences, markup, brackets and quotations, outermost first."""
    stack: list[str] = []
    for m in _MARKUP.finditer(text):
        mark = m.group()
        if mark in ("```", "~~~", "**", "__", '"'):
            if mark in stack:
                del stack[stack.index(mark) :]
            else:
                stack.append(mark)
        elif stack and stack[-1] in ("```", "~~~"):
            continue
        elif mark[0] == "<":
            name = re.sub(r"\W.*", "", mark.lstrip("</"), flags=re.S)
            if mark.startswith("</"):
                if f"<{name}" in stack:
                    del stack[stack.index(f"<{name}") :]
            elif not mark.endswith("/>") and name.lower() not in ("br", "hr", "img", "p", "li"):
                stack.append(f"<{name}")
        elif mark == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif mark in _PAIRS:
            stack.append(mark)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS.get(stack[k]) == mark:
                    del stack[k:]
                    break
    return stack


def open_item(text: str) -> bool:
    """The last item of a list stops short: it is empty, or lacks the closing mark that all other items have."""
    items = list(_ITEM.finditer(text))
    if not items or "\n\n" in text[items[-1].end() :].strip():
        return False
    last = text[items[-1].end() :].strip()
    depth = len(items[-1].group(1))
    before = [text[m.end() : n.start()].strip() for m, n in zip(items, items[1:]) if len(m.group(1)) == depth]
    return not last or (len(before) > 1 and all(map(is_closed, before)) and not is_closed(last))


def ends_open(text: str, odds: float, limit: float) -> bool:
    """The answer stops mid-word or mid-sentence: inside a fence, tag, bracket or list item, inside a quotation that its
    last sentence has opened, or in a context that goes on."""
    left = open_constructs(text)
    if any(x[0] in "`~<[{(" for x in left) or open_item(text):
        return True
    end = tail(text).rstrip("*_`~ \n")
    # quotations may run over paragraphs, so an open one tells only with an end that isn't closed
    if any(x in "«“„「" for x in left) and not is_closed(end):
        return True
    return odds < limit and not is_closed(end)


def wanted_language(prompt: str, languages: Languages) -> str | None:
    """The language a prompt asks for: the last one its request names, else its own."""
    head = prompt.strip().partition("\n")[0]
    request = head.partition(":")[0] if ":" in head else head[: (sentence_spans(head) or [(0, 0)])[0][1]]
    named = _NAME.findall(request)
    if named and not re.search(r"[?]\s*$", request):
        return _NAMES[named[-1].lower()]
    return languages.of(prompt)


class _Automaton:
    """Suffix automaton of a sequence: the longest factor that ends at each place of another one, in linear time."""

    def __init__(self, seq):
        self.next, self.link, self.length, self.at = [{}], [-1], [0], [-1]
        last = 0
        for i, c in enumerate(seq):
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.at.append(i)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.at.append(self.at[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def matches(self, seq, least: int):
        """(length, end in ``seq``, end in the automaton's sequence) of the factors that can't be extended to the right."""
        out, state, n = [], 0, 0
        for i, c in enumerate(seq):
            before = (n, i, self.at[state] + 1)
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            if before[0] >= least and n <= before[0]:
                out.append(before)
        if n >= least:
            out.append((n, len(seq), self.at[state] + 1))
        return out


def tiled(a, b, least: float = 0.0, tile: int = TILE) -> int:
    """Items of ``a`` covered by greedy string tiling: the longest common runs of at least ``tile`` items first, none
    twice, again and again until no run is left.

    0 as soon as it is certain that less than the part ``least`` of ``a`` can be covered.  Takes lists and strings.  A
    round is linear in the lengths (a suffix automaton of what is left of ``b``), also for texts that repeat themselves.
    """
    if len(a) < tile or len(b) < tile:
        return len(a) if a == b else 0
    key = (lambda x: x) if isinstance(a, str) else tuple
    grams = {key(b[j : j + tile]) for j in range(len(b) - tile + 1)}
    if tile * sum(key(a[i : i + tile]) in grams for i in range(len(a) - tile + 1)) < least * len(a):
        return 0
    # marked items become signs that equal nothing
    x, y = list(a), list(b)
    used_x, used_y = np.zeros(len(x) + 1, dtype=bool), np.zeros(len(y) + 1, dtype=bool)
    covered = 0
    while True:
        heap = [(-n, i - n, j - n) for n, i, j in _Automaton(y).matches(x, tile)]
        if not heap:
            return covered
        if covered + len(x) - np.count_nonzero(used_x) < least * len(a):
            return 0
        heapify(heap)
        while heap:
            n, i, j = heappop(heap)
            n = -n
            taken = np.flatnonzero(used_x[i : i + n] | used_y[j : j + n])
            if len(taken):
                # what other tiles have left of the run: its longest part comes up again
                edges = np.concatenate([[-1], taken, [n]])
                gaps = np.diff(edges) - 1
                k = int(np.argmax(gaps))
                if gaps[k] >= tile:
                    heappush(heap, (-int(gaps[k]), i + int(edges[k]) + 1, j + int(edges[k]) + 1))
                continue
            used_x[i : i + n] = used_y[j : j + n] = True
            x[i : i + n] = [("a", k) for k in range(i, i + n)]
            y[j : j + n] = [("b", k) for k in range(j, j + n)]
            covered += n


def is_copy(answer: str, prompt: str) -> bool:
    """The answer gives back the question or the source passage essentially unchanged, with or without a lead-in."""
    lead = _LEAD_IN.match(answer)
    body = answer[lead.end() :] if lead and len(answer) - lead.end() > 10 else answer
    head, _, rest = prompt.strip().partition("\n")
    passages = [words_of(p) for p in dict.fromkeys((prompt, rest, prompt.partition(":")[2])) if p.strip()]
    for text in dict.fromkeys((body, answer)):
        a = words_of(text)
        for b in passages:
            if not a or not b or len(b) > len(a) / COPY_PROMPT and len(b) > len(a) + 0.4 * len(b):
                continue  # too short to cover its part of the prompt either way
            # letters lost here and there leave few whole runs of words: tile characters where many words recur
            known = set(b)
            shared = sum(w in known for w in a)
            if shared < SHARED * len(a):
                continue  # no tiles, of words or of characters, can cover enough
            if (n := tiled(a, b, COPY_ANSWER)) >= COPY_ANSWER * len(a) and n >= COPY_PROMPT * len(b):
                return True
            if abs(len(a) - len(b)) <= 0.4 * len(b):
                x, y = " ".join(a), " ".join(b)
                if (n := tiled(x, y, CHARS_ANSWER, CHAR_TILE)) >= CHARS_ANSWER * len(x) and n >= CHARS_PROMPT * len(y):
                    return True
    return False


def defect_of(
    src: str, answer: str | None, prompt: str | None, lang: str | None, short: bool, garbled: bool, odds: float, limit: float,
    languages: Languages,
) -> str | None:
    """Type of the defect of an answer, None for a sound one."""
    if not answer or _VISIBLE.search(answer) is None:
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if prompt and (src == "chapters" or not _REPEAT.search(prompt.strip().partition("\n")[0])) and is_copy(answer, prompt):
        return "copy"
    if not garbled and (short or ends_open(answer, odds, limit)):
        return "truncated"
    want = lang if src == "chapters" else (wanted_language(prompt, languages) if prompt else None)
    if want:
        lead = _LEAD_IN.match(answer)
        body = answer[lead.end() :] if lead and len(answer) - lead.end() > 10 else answer
        got = languages.of(body)
        if got and got != want:
            return "language"
    return None


def flag_defects(pairs: DataFrame, model: EndModel, chains: ChainModel, languages: Languages) -> DataFrame:
    """(src, rec_id, defect) for the defective rows of (src, rec_id, answer, prompt, lang, words).

    Null and blank answers are 'empty'; without a prompt an answer is judged by itself; a repeated answer (another
    rec_id) is judged again.  Narrow stages; the models have fixed or checked size.
    """
    local = model.local is not None
    shared = pairs.sparkSession.sparkContext.broadcast((chains, languages, model.local, model.prior))
    limit = model.typical - MARGIN

    def rows(batches):
        chain, known, ends, prior = shared.value
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            if local:
                columns.append(text_odds(columns[2], ends, prior).tolist())
            for s, r, a, p, lg, w, o in zip(*columns):
                short = bool(w and a and len(a.split()) < 0.9 * w)
                hit = repair(a, chain) if s == "chapters" else None
                garbled = hit is not None
                a = hit[0] if garbled and hit[0] else a
                d = defect_of(s, a, p, label(lg), short, garbled, o, limit, known)
                if d:
                    found.append((s, r, d))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["src", "rec_id", "defect"])

    scored = pairs.select("src", "rec_id", "answer", "prompt", "lang", "words")
    scored = scored if local else with_odds(scored, "answer", model)
    return scored.mapInArrow(rows, "src string, rec_id long, defect string")


def answer_pairs(conversations: DataFrame, chapters: DataFrame) -> DataFrame:
    """(src, rec_id, answer, prompt, lang, words): assistant rows with the user row before them, LLM chapters with the
    original of their run and number.  Of several prompts for one answer the first counts."""
    prompts = (
        conversations.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn"))
        .agg(F.min_by("text", "msg_id").alias("prompt"))
    )
    talk = (
        conversations.where("role = 'assistant'").join(prompts, ["conv_id", "turn"], "left")
        .select(F.lit("conversations").alias("src"), F.col("msg_id").alias("rec_id"), F.col("text").alias("answer"), "prompt",
                F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("words"))
    )
    originals = (
        chapters.where("version like '%\\_original'").groupBy("run_id", "number").agg(F.min_by("text", "chapter_id").alias("prompt"))
    )
    made = (
        chapters.where("version like '%\\_llm%'").join(originals, ["run_id", "number"], "left")
        .select(F.lit("chapters").alias("src"), F.col("chapter_id").alias("rec_id"), F.col("text").alias("answer"), "prompt",
                "lang", F.col("word_count").alias("words"))
    )
    return talk.unionByName(made)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, chapters = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "chapters")
    # closing lines are rare in answers: ends are learned from the whole corpus
    texts = corpus(spark, sf_dir).unionByName(conversations.where("role = 'assistant'").select(F.col("text").alias("t")))
    labelled = chapters.select("lang", F.col("text").alias("t")).unionByName(table(spark, sf_dir, "documents").select("lang", F.col("text").alias("t")))
    return flag_defects(answer_pairs(conversations, chapters), fit_ends(texts), chapter_model(spark, sf_dir), fit_languages(labelled))
