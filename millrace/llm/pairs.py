"""Broken question and answer pairs: empty, refusing, copying, foreign-language and truncated answers.

Copies are found by aligning the answer with its question: containment of word shingles first, then a longest common subsequence
of words. Refusals are aligned with templates: wordings, and sequences of roles (who speaks, cannot or may not, a verb of answering or
helping, what was asked), each role with its words in four languages. Languages are told by function words. Whether an answer without a closing
sign breaks off is told by how its last words are used elsewhere: counts over all answers of how often two words close an
item, and how often they stand within one, join each such answer on its own last words.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import spread, stage

EMPTY, TRUNCATED, REFUSAL, COPY, LANGUAGE = "empty", "truncated", "refusal", "copies_question", "other_language"
#: Shingle containment and alignment that make a copy; share of a template's words in order that makes a refusal.
SHINGLE, CONTAINED, ALIGNED, REFUSES = 3, 0.5, 0.8, 0.8
#: Words among a template's own; words beside a refusal, courtesies, reasons and the question apart, that don't make an answer.
SPREAD, ASIDE = 16, 14
# Function words by language, refusal templates, placeholders.
WORDS = {
    "en": "the of and is are was were in to for with that this it its which what how on by as from not be been has have you your they them at or before when since more than does there an who why where should can each still about first takes most without between if".split(),
    "fr": "le la les des du de et est sont une un dans pour avec que qui sur par ne pas ce cette ces il elle nous vous leur son sa ses au aux en ou mais plus très où quand si comment quelle quel soit été d l n qu c s".split(),
    "de": "der die das und ist sind ein eine einen einem einer in im mit für auf nicht den dem des von zu zum zur wird wurde werden sie wir ihr ihre sich als auch bei aus nach wenn dass wie was wer wo warum es bis mehr kann können ohne vor".split(),
    "es": "el la los las de del y es son una un en para con que por no se su sus al lo como más pero o está fue ha usted cuando si qué cómo dónde cuál este esta esa ese todavía dos otra otro antes sin".split(),
}
_WORDS = {k: frozenset(v) for k, v in WORDS.items()}
REFUSALS = [
    "going to pass on that", "will have to look elsewhere for this one", "answering would go against my guidelines", "this is not something I can assist with",
    "falls outside what I'm allowed to discuss", "no answer will be given to this prompt", "let's move on to a different matter", "I'd rather leave this question to someone else",
    "I have been asked to stay away from such questions", "it would not be appropriate for me to comment", "I don't feel comfortable going into this topic", "I won't be answering this one",
    "I'd rather not answer", "my instructions don't permit a reply here", "je préfère ne pas aborder ce sujet", "cette question sort de mon cadre",
    "il m'est impossible de vous aider sur ce point", "mes règles m'interdisent de répondre", "je dois décliner cette demande", "mes consignes m'empêchent d'aller plus loin",
    "meine Richtlinien lassen das nicht zu", "das liegt außerhalb dessen, was ich darf", "mis normas me impiden contestar", "no me es posible responder a esta petición",
    "esa pregunta queda fuera de lo que se me permite", "prefiero no hablar de este tema", "prefiero no tratar este tema",
]
#: Courtesies that come with refusals, and words of the reasons given for them.
COURTESIES = [
    "you are asking about", "is there anything else", "feel free to ask", "ask me something else", "ask me about a different subject", "I hope you understand", "thank you for understanding", "I apologize for", "I'm sorry for", "happy to help with", "let me know if", "please consult", "please contact",
    "vous demandez", "n'hésitez pas", "posez moi une autre question", "merci de votre compréhension", "puis je vous aider", "je suis désolé", "veuillez consulter",
    "Sie fragen nach", "fragen Sie mich gern", "kann ich sonst", "danke für Ihr Verständnis", "es tut mir leid", "bitte wenden Sie sich",
    "usted pregunta por", "no dude en", "pregúnteme otra cosa", "gracias por su comprensión", "lo siento", "hay algo más", "consulte con",
]
REASONS = "guideline guidelines policy policies instructions consignes règles directives richtlinien vorgaben regeln normas directrices políticas".split()
#: Roles of words in a refusal, and the sequences of roles that are one; END: nothing else follows.
ROLES = {
    "I": "i im id ive myself",
    "CANT": "cant cannot wont couldnt wouldnt unable",
    "NOT": "not dont never neither",
    "ABLE": "able ability permitted allowed authorized authorised position comfortable capacity permission supposed willing equipped",
    "REFUSE": "refuse decline abstain refrain declining refusing",
    "ACT": "answer help assist discuss comment respond reply engage address advise say share do talk speak provide give offer continue complete fulfil fulfill support",
    "IT": "this that it these such your here request requests question questions topic matter subject prompt query you",
    "JE": "je j", "NE": "ne n", "PEUX": "peux puis suis souhaite veux vais saurais dois", "REFUSER": "refuse decline decliner refuser abstiens abstenir renonce",
    "FAIRE": "repondre aider discuter commenter aborder traiter donner fournir parler dire",
    "ICH": "ich", "KANN": "kann darf werde mochte will bin", "NICHT": "nicht nichts keine kein", "ABLEHNEN": "ablehnen lehne verweigere weigere verweigern",
    "TUN": "beantworten helfen weiterhelfen antworten aussern auskunft sagen diskutieren besprechen eingehen behandeln",
    "NO": "no", "PUEDO": "puedo debo quiero deseo estoy podre", "NIEGO": "niego rechazo rechazar rehuso declino declinar",
    "HACER": "ayudar ayudarle ayudarte responder responderle contestar comentar hablar tratar ofrecer proporcionar decir discutir",
}
ROLE_TEMPLATES = [
    "I CANT ACT IT", "I CANT ACT END", "I NOT ABLE ACT", "I REFUSE ACT", "I REFUSE IT", "I REFUSE END",
    "JE NE PEUX FAIRE", "JE REFUSER FAIRE", "JE REFUSER END", "ICH KANN NICHT TUN", "KANN ICH NICHT TUN", "ICH NICHT TUN END", "ICH ABLEHNEN", "KANN ICH ABLEHNEN",
    "NO PUEDO HACER", "NIEGO HACER", "PUEDO NIEGO", "NIEGO END",
]
NOTHING = frozenset(["", "null", "none", "nil", "na", "n a", "no answer", "answer", "undefined", "empty", "nan", "response", "no response", "output", "no content", "content", "result", "tbd", "todo"])
TARGETS = {"en": r"english|anglais|englisch\w*|inglés|ingles", "fr": r"french|français|francais|französisch\w*|francés|frances", "de": r"german|allemand|deutsch\w*|alemán|aleman", "es": r"spanish|espagnol|spanisch\w*|español|espanol|castellano"}
_TARGET = {k: re.compile(rf"(?i)\b(?:into|in|en|au|ins?|auf|al)\s+(?:{v})\b") for k, v in TARGETS.items()}
_TRANSLATION = re.compile(r"(?i)translat|say this|say it|tradui|comment dit|comment dire|übersetz|wie sagt|wie heißt|traduc|traduz|cómo se dice|como se dice")
_ANY_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)?")
_LETTERS = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…。][\"'”»)*_\]]*$|[\"”»)`}\]]$|\*\*$")
_INNER = re.compile(r"[.!?][\"'”»)]?\s+\S")
_ITEM = re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+")
_FENCE = re.compile(r"(?s)```.*?(?:```|$)")
_LEAD = re.compile(r"(?i)^\s*(?:sure|certainly|of course|good question|here you go|in short|here is the reasoning|question|you asked|please help|quick one|answer|q|claro|en resumen|bien sûr|en bref|gerne|kurz gesagt|buena pregunta|bonne question|gute frage)\s*[.:,!-]+\s*")


_MARKS = {c: None for c in range(0x300, 0x1E000) if unicodedata.combining(chr(c))} | {c: None for c in [*range(0xFE20, 0xFE30), ord("'"), ord("’")]}


def _plain(text: str) -> list[str]:
    if text.isascii():
        return _LETTERS.findall(text.lower().replace("'", ""))
    return _LETTERS.findall(unicodedata.normalize("NFKD", text.casefold()).translate(_MARKS))


_asked = lru_cache(4096)(_plain)


class Templates:
    """Templates by the words of which a sentence must have at least one to align with enough of a template."""

    def __init__(self, texts: list[str]):
        self.words = [_plain(t) for t in texts]
        self.by_word: dict[str, list[int]] = {}
        for i, t in enumerate(self.words):
            distinct = sorted(set(t), key=lambda w: (-len(w), w))
            least = math.ceil(REFUSES * len(t) - (len(t) - len(distinct)))
            for w in distinct[: len(distinct) - max(1, least) + 1]:
                self.by_word.setdefault(w, []).append(i)

    def near(self, there: frozenset[str]) -> list[list[str]]:
        return [self.words[i] for i in sorted({i for w in there if w in self.by_word for i in self.by_word[w]})]


_REFUSALS, _POLITE = Templates(REFUSALS), Templates(COURTESIES)
_REASONS = frozenset(w for x in REASONS for w in _plain(x))
_ROLE: dict[str, set[str]] = {}
for _r, _ws in ROLES.items():
    for _w in _ws.split():
        _ROLE.setdefault(_w, set()).add(_r)
_ROLE_TEMPLATES = [t.split() for t in ROLE_TEMPLATES]
_MAIN = frozenset(w for r in ("CANT", "ABLE", "REFUSE", "REFUSER", "FAIRE", "ABLEHNEN", "TUN", "NIEGO", "HACER") for w in ROLES[r].split())
#: Words between two roles of a template.
BETWEEN = 4


def _role_spot(words: list[str]) -> tuple[int, int] | None:
    """The first stretch of words that holds a template of roles in order, its words close together."""
    if _MAIN.isdisjoint(words):
        return None
    roles = [_ROLE.get(w, frozenset()) for w in words]
    for t in _ROLE_TEMPLATES:
        for begin in range(len(words)):
            if t[0] not in roles[begin]:
                continue
            at = begin
            for r in t[1:]:
                if r == "END":
                    at = at if at == len(words) - 1 else -1
                else:
                    at = next((k for k in range(at + 1, min(len(words), at + 2 + BETWEEN)) if r in roles[k]), -1)
                if at < 0:
                    break
            if at >= 0:
                return begin, at + 1
    return None


def aligned(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence of words."""
    masks: dict[str, int] = {}
    for j, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << j
    every = v = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


@lru_cache(16)
def spoken(text: str) -> str:
    """What an answer says: the values of a JSON object, else the text, without tags."""
    s = text.strip()
    if s.startswith("{"):
        try:
            found = json.loads(s)
            if isinstance(found, dict):
                values = [str(v) for k, v in found.items() if isinstance(v, str) and k not in ("confidence", "language")]
                return " ".join(values) if values or not found else s
        except ValueError:
            s = re.sub(r'[{}]|"\w+"\s*:', " ", s)
    return re.sub(r"</?[A-Za-z][^<>]*>", " ", s)


def is_empty(text: str | None) -> bool:
    """No content, or none that says anything: blank, signs only, a placeholder, an empty wrapper."""
    if text is None:
        return True
    said = spoken(text)
    words = [w for w in _ANY_WORD.findall(said)]
    return " ".join(words).casefold() in NOTHING


def _spot(t: list[str], words: list[str]) -> tuple[int, int] | None:
    """The shortest stretch of words, not much longer than a template, that holds enough of it in order; the first of these."""
    best, there = None, frozenset(t)
    for i in range(len(words)):
        if words[i] in there:
            stretch = words[i : i + len(t) + SPREAD]
            if aligned(t, stretch) >= REFUSES * len(t):
                n = next(n for n in range(1, len(stretch) + 1) if aligned(t, stretch[:n]) >= REFUSES * len(t))
                if best is None or n < best[1] - best[0]:
                    best = i, i + n
    return best


def _without(words: list[str], templates: Templates) -> list[list[str]] | None:
    """What stands before and after a template; None if none is there."""
    for t in templates.near(frozenset(words)):
        if at := _spot(t, words):
            return [words[: at[0]], words[at[1] :]]
    return None


def _refused(words: list[str]) -> list[list[str]] | None:
    """What stands before and after a refusal; None if there is none."""
    found = _without(words, _REFUSALS)
    if not found and (at := _role_spot(words)):
        found = [words[: at[0]], words[at[1] :]]
    return found


def _left(words: list[str], asked: list[str]) -> int:
    """Words of a passage that may answer: none if it is a courtesy, gives reasons for refusing or restates the question."""
    if not words or _REASONS & set(words) or _without(words, _POLITE) or _refused(words):
        return 0
    return 0 if len(words) > 2 and aligned(words, asked) >= REFUSES * len(words) else len(words)


def is_refusal(text: str, question: str | None = None) -> bool:
    """A sentence, wherever it stands, holds a refusal template's words in order, close together; what else is said doesn't answer."""
    parts = [w for p in re.split(r"(?<=[.!?;])\s+|\n+", spoken(text).strip()) if (w := _plain(p))]
    refused = next(((i, around) for i, w in enumerate(parts) if (around := _refused(w))), None)
    if not refused:
        return False
    i, around = refused
    asked = _asked(question or "")
    return sum(_left(w, asked) for w in [*around, *parts[:i], *parts[i + 1 :]]) <= ASIDE


def is_copy(question: str | None, text: str) -> bool:
    """The answer gives back the question, slightly changed, and adds hardly anything."""
    if not question:
        return False
    q = _asked(question)
    if spoken(text).count(" ") > 3 * len(q) + 40:
        return False
    a = _plain(_LEAD.sub("", spoken(text)))
    while a[-1:] in (["answer"], ["antwort"], ["reponse"], ["respuesta"]):
        a.pop()
    if not a or len(q) < 3 or len(a) > 1.35 * len(q) + 3 or len(a) < 0.6 * len(q):
        return False
    grams = {tuple(q[i : i + SHINGLE]) for i in range(len(q) - SHINGLE + 1)}
    held = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    if len(grams & held) < CONTAINED * len(grams) * 0.8 and not (len(q) <= 8 and aligned(q, a) >= 0.7 * len(q)):
        return False
    both = aligned(q, a)
    return both >= ALIGNED * len(a) and both >= 0.7 * len(q)


_LANGUAGES = {w: [k for k, v in _WORDS.items() if w in v] for w in frozenset().union(*_WORDS.values())}
_WORD_PART = re.compile(r"[^\W_]+")


def language_counts(text: str) -> dict[str, int]:
    n = dict.fromkeys(_WORDS, 0)
    for w in _WORD_PART.findall((_FENCE.sub(" ", text) if "```" in text else text).casefold()):
        for k in _LANGUAGES.get(w, ()):
            n[k] += 1
    return n


def language(text: str | None, least: int = 1) -> str | None:
    """en, fr, de or es by function words; None if too few of them, or two languages are level."""
    if not text:
        return None
    ranked = sorted(((n, k) for k, n in language_counts(text).items()), reverse=True)
    return ranked[0][1] if ranked[0][0] >= least and ranked[0][0] > ranked[1][0] else None


@lru_cache(4096)
def expected_language(question: str | None) -> str | None:
    if not question:
        return None
    if _TRANSLATION.search(question):
        for k, p in _TARGET.items():
            if p.search(question):
                return k
    return language(re.split(r":\s", question)[0] if _TRANSLATION.search(question) else question)


def is_foreign(question: str | None, text: str) -> bool:
    """Most function words of the answer, without a repeated question, are of a language that isn't called for."""
    want = expected_language(question)
    if want is None:
        return False
    said = spoken(text)
    if question and question.strip() in said:
        said = said.replace(question.strip(), " ")
    said = _LEAD.sub("", said)
    n = language_counts(said)
    best = max(n, key=lambda k: (n[k], k == want))
    words = len(_ANY_WORD.findall(said))
    # a short answer may lack function words: two more than the expected language has, or all of a few words
    return best != want and (n[best] >= n[want] + 2 and n[best] >= 1.5 * n[want] + 1 or 0 < words <= 6 and n[want] == 0 and n[best] >= 2)


def _shape(word: str, first: bool) -> str:
    if word.islower():
        return word
    if word[0].isdigit():
        return "9"
    return "N" if word[0].isupper() and not first else word.casefold()


def items_of(text: str) -> list[list[str]]:
    """The sentences and list items of an answer as shaped words: names and numbers are alike."""
    parts = re.split(r"(?<=[.!?:;])\s+|\n+", _FENCE.sub("\n", spoken(text)))
    out = []
    for p in parts:
        words = re.findall(r"\w+", _ITEM.sub("", p))
        if words:
            out.append([_shape(w, i == 0) for i, w in enumerate(words)])
    return out


def breaks_off(text: str) -> bool | None:
    """Whether an answer breaks off, by its form; None: only its last words can tell."""
    s = text.strip()
    if s.startswith("{"):
        try:
            json.loads(s)
            return False
        except ValueError:
            return s.count("{") != s.count("}") or s.count('"') % 2 == 1
    if s.count("```") % 2 == 1:
        return True
    if s.endswith("```"):
        return False
    if re.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])$", s) or s[-1:] in ",;:(-–/" and not re.search(r"(?i)answer:$", s):
        return len(_LETTERS.findall(s)) > 2
    last = s.rsplit("\n", 1)[-1].strip()
    if re.match(r"(?i)(?:final )?answer\s*[:=]|\\boxed|####", last) or re.search(r"\\boxed\{[^{}]*\}$", s):
        return False
    if _END.search(s):
        return False
    if len(re.findall(r"\w+", s)) < 4:
        return False
    if _INNER.search(_ITEM.sub("", s)) or re.search(r"[.!?]\s*\n", s):
        return True  # earlier sentences are closed, the last is not
    return None


def answers(results: DataFrame) -> DataFrame:
    """(result_id, custom_id, content): one row a distinct non-null result_id without error. Any level of response may be null or empty.

    Of rows that differ under one id, one with content counts, and of those the least.
    """
    content = F.get(F.col("response.body.choices"), F.lit(0)).getField("message").getField("content")
    r = results.where("error is null and result_id is not null").select("result_id", "custom_id", content.alias("content"))
    return r.groupBy("result_id").agg(F.min("custom_id").alias("custom_id"), F.min("content").alias("content"))


_CHECKED = "result_id long, defect string, w1 string, w2 string, head string, whole string, closing long, inner long"
#: An unclosed last item is whole if so many answers end in the same, and they are that share of those that begin alike.
ALIKE, SHARE = 3, 0.3


def defects(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(result_id, defect): every defective answer, once, with the first defect of empty, refusal, copies_question, other_language, truncated.

    Rows with an error are left out. An answer without a question (unknown, null or blank) can be empty, a refusal or truncated.
    Of repeated question ids the least text counts. Empty tables give no rows; other columns are not read.
    """
    asked = questions.where("id is not null").groupBy("id").agg(F.min("question").alias("question"))
    a = answers(results).withColumnRenamed("custom_id", "id").join(asked, "id", "left").select("result_id", "content", "question")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each defect, one for each answer that only its last words can tell, and counts of words that close items (without result_id)."""
        for b in batches:
            out: list[tuple] = []
            ends: dict[tuple[str, str], list[int]] = {}
            for k, t, q in zip(b["result_id"], b["content"], b["question"]):
                t, q = (x if isinstance(x, str) else None for x in (t, q))
                items = items_of(t) if t else []
                for words in items:
                    w = ["", *words]
                    for i in range(1, len(w)):
                        ends.setdefault((w[i - 1], w[i]), [0, 0])[i < len(w) - 1] += 1
                if is_empty(t):
                    out.append((k, EMPTY))
                elif is_refusal(t, q):
                    out.append((k, REFUSAL))
                elif is_copy(q, t):
                    out.append((k, COPY))
                elif is_foreign(q, t):
                    out.append((k, LANGUAGE))
                else:
                    off = breaks_off(t)
                    if off:
                        out.append((k, TRUNCATED))
                    elif off is None and (last := (items or [[]])[-1]):
                        out.append((k, None, last[-2] if len(last) > 1 else "", last[-1], " ".join(last[:3]), " ".join(last)))
            rows = [(*x, None, None, None, None)[:6] + (None, None) for x in out] + [(None, None, *w, None, None, *n) for w, n in ends.items()]
            made = pd.DataFrame(rows, columns=["result_id", "defect", "w1", "w2", "head", "whole", "closing", "inner"])
            yield made.astype({c: "Int64" for c in ("result_id", "closing", "inner")})

    checked = stage(spread(a, "result_id", results).mapInPandas(check, _CHECKED), "checked")
    usage = checked.where("closing is not null").groupBy("w1", "w2").agg(F.sum("closing").alias("closing"), F.sum("inner").alias("inner"))
    checked = checked.where("closing is null").drop("closing", "inner")
    unclosed = checked.where("defect is null").drop("defect")
    alike = unclosed.groupBy("head", "whole").agg(F.count("*").alias("n"))
    begun = alike.groupBy("head").agg(F.sum("n").alias("n_head"))
    whole = alike.join(begun, "head").where((F.col("n") >= ALIKE) & (F.col("n") >= SHARE * F.col("n_head"))).select("whole")
    # two words that close items elsewhere may close this one too; its own use counts once
    cut = unclosed.join(whole, "whole", "left_anti").join(usage, ["w1", "w2"], "left").where((F.coalesce("closing", F.lit(0)) < 2) | (F.col("closing") < 0.2 * F.col("inner")))
    return checked.where("defect is not null").select("result_id", "defect").unionByName(cut.select("result_id", F.lit(TRUNCATED).alias("defect")))
