"""Defects of question and answer pairs: empty, truncated, copies_question, refusal, other_language.

Every rule looks at every response, in its usual wrappers (code fence, JSON object, label), and all that
are triggered come out; an order says which is the decisive one:

1. ``empty``: nothing meaningful, or a complete wrapper with a blank answer;
2. ``truncated``: unclosed fence, bracket or quote, an abrupt end, or reasons that lead to no answer;
3. ``copies_question``: after removal of the question, its options and lead-ins nothing is left;
4. ``refusal``: a sentence in which the speaker denies or declines an act of speech (answering, helping,
   judging ...), in the languages of the phrase table, while no answer is given;
5. ``other_language``: script, letters or function words belong to another language than the question's.

A prediction that is an option letter shows that an answer was there. Rows are independent, so the
operator is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFECTS = ("empty", "truncated", "copies_question", "refusal", "other_language")

_INVISIBLE = re.compile(r"[​-‏ -‮⁠-⁤﻿­]")
_NOTHING = re.compile(r"(?i)\s*(?:n\s*/\s*a|null|none|nil|nan|undefined|\[\s*\]|\{\s*\}|[\W_]*)\s*\Z")
_LABEL = re.compile(r"(?i)^\s*(?:(?:the |final )*answer|antwort|respuesta|r[eé]ponse|output|response)\s*[:：]\s*")
_BLANK_WORDS = frozenset(("", "n/a", "na", "none", "null", "unknown", "nan"))
_LETTER_ONLY = re.compile(r"\s*[(\[]?\s*[A-Ha-h]\s*[)\]]?\s*[.:]?\s*\Z")
#: A conclusion that names a letter, at the end of a text.
_CONCLUSION = re.compile(
    r"(?i)(?:(?<!\w)(?:answer|choose|choice|option|antwort|w[aä]hle|respuesta|elijo|opci[oó]n|r[eé]ponse|choisis|donc|risposta|scelgo|resposta|escolho|antwoord|kies|odpowied[zź]|svar(?:et)?|ответ)(?!\w)|答案|答え|正解|回答|정답)"
    r"\s*(?:(?:correcta|correta|corretta|certa|ich|option|opci[oó]n|is|ist|es|est|[eé]|è|to|[aä]r|er)(?!\w)|是|は|为|은|는)?\s*(?:(?:therefore|la|the|option|opci[oó]n)(?!\w)|l')?\s*(?:la opci[oó]n\s*)?[:：—–-]?\s*[\"'“«(\[]*\s*[A-H]\s*[\"'”»)\]]*[.!。]?\s*\Z"
)
_LAST_LETTER = re.compile(r"(?:^|\n\s*|:\s*)[(\[\"'«“]*[A-H][)\]\"'»”]*[.!]?\s*\Z")
_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]}`*]*\s*\Z")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)\s*\Z")
_OPTION_MARK = re.compile(r"^\s*\(?[A-Ha-h][.):]\s*")
_OPTION_LINE = re.compile(r"(?m)^\s*\(?[A-H][.):]\s.*$")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*")

#: Words by which a speaker declines, by language: (the speaker, denial, acts of speech, declining as such).
#: A sentence refuses if it has a speaker and either a denial with an act of speech or a declining word.
#: Endings of verbs are left open. Fixed values.
_DECLINING = {
    "en": (
        r"i|i'm|i'd|i'll|i've|me|my|myself|mine|we|our",
        r"\w+n't|not|cannot|cant|unable|never|no|nor|neither|outside|beyond|against|rules? out|ruled out|forbids?|prevents?|prohibit\w*|inappropriate|impossible",
        r"answer\w*|repl\w+|respon\w+|comment\w*|say|judg\w+|verdict|opinion|assist(?!ant)\w*|help\w*|discuss\w*|provid\w+|shar(?:e|ing)|identif\w+|speculat\w+|offer|compl(?:y|ies)|fulfil\w*|engage|guess|weigh in|address|do that|do this|do so|tell you",
        r"declin\w+|refus\w+|abstain\w*|pass|skip|sit \w+ (?:\w+ )?out|leave\b.{0,25}\b(?:unanswered|to others|open|to someone else)|(?:rather|prefer|choose|better) not|unanswered|withhold\w*|(?:n't|not) feel comfortable|(?:not|n't) comfortable|excuse myself|stay silent",
    ),
    "de": (
        r"ich|mir|mich|mein\w*|wir|uns",
        r"nicht|keine?\w*|nie|unm[oö]glich|au(?:ß|ss)erhalb|untersag\w+|verbiet\w+|verwehrt",
        r"\w*antwort\w*|sagen|sage|[aä]u(?:ß|ss)er\w*|helfen|helfe|hilfe|behilflich|auskunft|urteil\w*|beurteil\w*|kommentier\w*|kommentar|stellung|angaben?|meinung",
        r"passen|ablehn\w*|lehne|verweiger\w*|enthalte\w*|[uü]berspring\w*|lieber nicht|verzicht\w*",
    ),
    "es": (
        r"yo|me|mi|m[ií]|puedo|podr[ií]a|debo|prefiero|preferir[ií]a|quiero|voy|estoy|tengo|soy|lamento|contesto|respondo|contestar[eé]|responder[eé]|opino|niego|abstengo|rechazo",
        r"no|nunca|tampoco|imposible|fuera|sin",
        r"respond\w*|respuesta|contest\w*|ayud\w*|opin\w*|decir\w*|digo|coment\w*|identific\w*|juzg\w*|pronunci\w*|ofrec\w*|permitid\w*",
        r"absten\w*|abstengo|niego|declin\w*|rechaz\w*|prefiero no|preferir[ií]a no|paso",
    ),
    "fr": (
        r"je|j'\w*|me|m'\w*|moi|mon|ma|mes|nous",
        r"ne|n'\w*|pas|jamais|impossible|aucune?|hors|interdi\w*",
        r"r[eé]pon\w*|aider|aide|dire|comment\w*|prononc\w*|juger|avis|fournir|donner|identifi\w*|permis|m'exprimer",
        r"abst(?:enir|iens)|m'abst\w+|d[eé]clin\w*|refus\w*|pr[eé]f[eè]r\w* ne|passer mon tour|m'abstenir",
    ),
    "it": (
        r"io|mi|me|mio|posso|potrei|devo|preferisco|preferirei|voglio|vorrei|sono|rispondo|risponder[oò]|riesco",
        r"non|mai|impossibile|nessun\w*",
        r"rispond\w*|risposta|risponder[oò]|aiut\w*|dire|comment\w*|giudic\w*|pronunci\w*|fornir\w*|opinion\w*",
        r"asteng\w*|astener\w*|rifiut\w*|declin\w*|preferi(?:sco|rei) non|passo",
    ),
    "pt": (
        r"eu|me|meu|minha|mim|posso|poderia|devo|prefiro|preferia|quero|vou|estou|sou|consigo|lamento|respondo",
        r"n[aã]o|nunca|imposs[ií]vel|nenhum\w*|fora",
        r"respond\w*|respost\w*|ajud\w*|dizer|coment\w*|opin\w*|julg\w*|fornec\w*|identific\w*|pronunci\w*",
        r"recus\w*|abst[eê]\w*|abstenho|prefiro n[aã]o|declin\w*|rejeit\w*",
    ),
    "nl": (
        r"ik|mij|me|mijn|wij",
        r"niet|geen|nooit|onmogelijk",
        r"antwoord\w*|beantwoord\w*|helpen|help|zeggen|commentaar|oordel\w*|uitspraak|reageren|mening|behulpzaam",
        r"weiger\w*|onthoud|liever niet|sla .{0,20}over|pas (?:hier|op|voor)",
    ),
    "pl": (
        r"ja|mi|mnie|mog[eę]|potrafi[eę]|chc[eę]|b[eę]d[eę]|jestem|wol[eę]|musz[eę]|odmawiam|udziel[eę]|odpowiem|przykro",
        r"nie|niemo[zż]liw\w*|[zż]adn\w*",
        r"odpowie\w*|odpowiad\w*|pom[oó]c|powiedzie\w*|komentow\w*|oceni\w*|udzieli\w*|wypowiada\w*",
        r"odmawiam|odm[oó]wi\w*|wol[eę] nie|wstrzym\w*",
    ),
    "sv": (
        r"jag|mig|min|mitt|vi|jeg|meg|mig",
        r"inte|ikke|aldrig|om[oö]jligt|ingen|inget|utanf[oö]r",
        r"svar\w*|besvar\w*|hj[aä]lpa|hj[aæ]lpe|s[aä]ga|kommenter\w*|uttala|bed[oö]ma|uttale",
        r"avst[aå]\w*|avb[oö]j\w*|v[aä]grar|helst inte|afst[aå]r|avsl[aå]r|n[aæ]gter",
    ),
    "ru": (
        r"я|мне|меня|мой|могу|буду|хочу|хотел\w*|предпочитаю|вынужден\w*|мы",
        r"не|нельзя|невозможно|никак\w*",
        r"ответ\w*|отвеча\w*|помоч\w*|помога\w*|сказать|коммент\w*|суди\w*|обсужда\w*",
        r"отказыва\w*|откажусь|воздерж\w*|предпочитаю не|уклон\w*",
    ),
}
_REFUSALS = [tuple(re.compile(rf"(?<!\w)(?:{x})(?!\w)") for x in words) for words in _DECLINING.values()]
_MAY_REFUSE = re.compile("|".join(rf"(?<!\w)(?:{no}|{out})(?!\w)" for _, no, _, out in _DECLINING.values()))
#: Languages without blanks between words: (act of speech ... denial) or (denial ... act of speech).
_REFUSALS_CJK = re.compile(
    r"(?:答|回答|お手伝い|コメント|判断|意見)[^。！？]{0,10}(?:ません|ない|できかね|控え|差し控)|(?:控え|辞退)させて"
    r"|(?:无法|無法|不能|不便|拒绝|拒絕|不会|不會|不方便|恕不|不予)[^。！？]{0,8}(?:回答|答复|答覆|帮|幫|提供|评论|評論|判断|判斷|奉告)|无可奉告"
    r"|(?:답변|대답|답|도와|의견)[^.!?]{0,10}(?:없|않|못|어렵|거절)"
)
#: Words of talk about the evidence rather than of an answer. Fixed values.
_EVIDENCE = re.compile(
    r"(?i)(?<!\w)(?:options?|frames?|clips?|captions?|question|events?|segments?|footage|screen|picture|scene|resolution|seconds?|choice|view|"
    r"bild|optionen|abschnitt|sekunden?|frage|szene|ausschnitt|imagen|opci[oó]n|opciones|fragmento|segundos?|escena|pregunta|l'image|image|passage|secondes?|sc[eè]ne)(?!\w)"
)
#: Openings by which a sentence states an answer. Fixed values.
_STATES = re.compile(
    r"(?i)^\W*(?:it|that|this|they|there)(?:'s| is| are| was| were| would be)(?! not)(?!\w)|^\W*(?:the answer|it must|das (?:ist|sind|war)|es (?:ist|sind|handelt)|zu sehen (?:ist|sind)|man sieht|es |son |hay |se trata|se ve |aparece "
    r"|c'est|ce sont|il s'agit|on voit|il y a|[eè] |sono |si tratta|[eé] |trata-se|het is|dat is|to jest|det [aä]r)"
)

_ASKED = re.compile(
    r"(?i)^\W*(?:you asked|you ask|the question is|the question was|question|q|frage|die frage(?: lautet| ist)?|ihre frage|pregunta|la pregunta(?: es)?|question pos[eé]e|la question(?: est)?|vous demandez|preguntas|sie fragen|du fragst)\b\s*[:：,]?\s*"
)

#: Function words that tell the languages of the questions apart. Fixed values.
_FUNCTION_WORDS = {
    "en": "the is are was and of to in that it this with what which where how many does do can be seen shown as near there so not answer at on by because for from you have has but would since they an or fits since option options",
    "de": "der die das ist sind und zu nicht ein eine einen dem den des im um wird was wo wer wie auf mit für während bleibt daher passt aber davon es sich ich von bei zum zur erkennen sehen daneben nach als auch wenn ins kommt antwort am richtige weil dass",
    "es": "el la los las es son y de que no un una en se qué cuál dónde hacia mientras con por para así lo al del está pero como cuando muestra más su respuesta porque le esto hay aparece tiene trata opción opciones durante unos unas ve eso ese este sobre entre sin muy también solo ya",
    "fr": "le la les est sont et de que ne pas un une des dans en se qu'est qui où vers pendant avec pour ainsi ce du au cela mais comme quand montre plus son réponse c'est il elle sur donc l'on une aux entre quel quelle s'agit par",
}
#: Languages that answers may come in besides: frequent function words. Fixed values.
_FURTHER = {
    "it": "il lo gli i della dello delle dei che è si non per uno un una del alla questa questo quello perché verso sono più con risposta quindi le e ma basta scena vede circa al nella nel possono",
    "pt": "os da do das dos não em uma uns umas é que para isso mas com resposta nenhum pela pelo certa vê ao há portanto mostra esta outras outros durante",
    "nl": "de het een en van ik is dat niet op te zijn met voor er die wordt hier naar aan bij ook maar om dan nog wel deze dit heeft staat dus daarom antwoord welke geen zich kunnen",
    "sv": "och att det som en ett är av för på med den till inte de om var han hon har jag men så här från kan svaret syns eftersom bilden därför ingen detta vid",
    "da": "og at det som en et er af for på med den til ikke de om var han hun har jeg men så her fra kan svaret ses fordi billedet derfor ingen dette ved",
    "pl": "i w na z do się nie że to jest jak ale po od przez dla są przy tym który która jego więc odpowiedź widać ponieważ obraz tylko może oraz za",
    "cs": "a v na z do se ne že to je jak ale po od pro jsou při který která jeho tak odpověď vidět protože obraz jen může nebo za není",
    "tr": "ve bir bu için ile de da çok daha ne olarak gibi ama var olan kadar sonra değil görüntü cevap çünkü olduğu yanıt şu veya ise",
    "ro": "și în de la cu pe nu este un o care ce mai din pentru sunt dar sau prin se al ale răspunsul deci aceasta fost imaginea",
    "fi": "ja on ei se että kuin mutta tai ovat hän oli joka tämä niin myös kun vain vastaus siis kuvassa näkyy koska",
    "hu": "és a az hogy nem egy is meg van ez de csak volt már mint vagy ki azt mert válasz tehát képen látható ezért",
    "id": "yang dan di ini itu dengan untuk dari tidak dalam adalah pada ke akan juga karena jawaban terlihat gambar jadi oleh",
    "vi": "và của là có không được trong cho một này các với người đã những câu trả lời hình vì nên",
}
#: Letters that only some of these languages use. Fixed values.
_LETTERS = {"pl": "ąćęłńśźż", "cs": "ěřůčšž", "tr": "ğışİ", "ro": "șțăâ", "hu": "őű", "vi": "ơưđạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "sv": "å", "da": "æøå", "de": "ß", "es": "ñ¿¡", "pt": "ãõ", "fr": "œ"}
#: Those of which two words tell less than of a neighbouring language.
_RARE = frozenset(_FURTHER) - {"it", "pt"}
_SETS = {k: frozenset(v.split()) for k, v in (_FUNCTION_WORDS | _FURTHER).items()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_QUOTED = re.compile(r"«[^»]*»|„[^“”]*[“”]|“[^”]*”|\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)")


def _plain(text: str) -> str:
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))


def _script(text: str) -> str | None:
    """Script of most letters, coarse: latin, cyrillic, arabic, cjk, ..."""
    seen: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            if c < "ɐ":
                s = "LATIN"
            else:
                s = unicodedata.name(c, "OTHER").split(" ")[0]
                s = {"HIRAGANA": "CJK", "KATAKANA": "CJK"}.get(s, s)
            seen[s] = seen.get(s, 0) + 1
    return max(seen, key=lambda k: (seen[k], k)) if seen else None


@lru_cache(1 << 14)
def language(question: str) -> str | None:
    """Language of a question by its function words; None if they do not tell."""
    words, letters = _language_marks(question.replace("’", "'"))
    sc = {k: sum(n for w, n in words.items() if w in _SETS[k]) + letters.get(k, 0) for k in _FUNCTION_WORDS}
    best = max(sc, key=lambda k: (sc[k], k))
    rest = max(v for k, v in sc.items() if k != best)
    return best if sc[best] > rest else None


def _unwrap(text: str) -> tuple[str, bool]:
    """Content of a code fence, and whether a fence was left open."""
    m = _FENCE.match(text)
    if not m:
        return text, False
    rest = text[m.end() :]
    at = rest.rfind("```")
    return (rest[:at], False) if at >= 0 else (rest, True)


def _balanced(text: str) -> bool:
    """Brackets and double quotes of a JSON-like text are closed."""
    depth, quoted, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return depth <= 0 and not quoted


def _remainder(text: str, question: str, options: list[str]) -> list[str]:
    """Words of a text without the question (as is or slightly changed), lead-ins and options."""
    words, q = _plain(text).split(), _plain(question).split()
    if not q:
        return words
    left, i, n = [], 0, len(q)
    while i < len(words):
        if words[i : i + n] == q:
            i += n
        else:
            left.append(words[i])
            i += 1
    if len(left) == len(words):  # slightly changed: most words of the question in its order
        at, hit = 0, []
        for k, w in enumerate(words):
            for j in range(at, min(at + 5, n)):
                if q[j] == w:
                    hit.append(k)
                    at = j + 1
                    break
        if len(hit) >= max(3, 0.8 * n):
            left = [w for k, w in enumerate(words) if k not in set(hit)]
    return left


def _copies(text: str, question: str, options: list[str]) -> bool:
    body = _ASKED.sub("", text)
    listed = _OPTION_LINE.findall(body)
    if len(listed) > 1:  # an option list is given back with the question
        body = _OPTION_LINE.sub("", body)
    left = _remainder(body, question, options)
    if len(left) == len(_plain(body).split()):
        return False
    opts = [_plain(_OPTION_MARK.sub("", o)) for o in options if o]
    joined = f" {' '.join(left)} "
    shown = 0
    for o in sorted((o for o in opts if o), key=len, reverse=True):
        if f" {o} " in joined:
            shown += 1
            joined = joined.replace(f" {o} ", " ", 1)
    rest = [w for w in joined.split() if not re.fullmatch(r"[a-h]", w) and w not in ("options", "question", "frage", "pregunta")]
    if shown == 1 and len(opts) > 1:
        return False  # the question restated and one option given: an answer
    letters = [w for w in left if re.fullmatch(r"[a-d]", w)]
    if not shown and len(letters) == 1 and letters[0] not in _plain(question).split():
        return False
    return len(rest) <= max(1, len(_plain(question).split()) // 5)


def _fields(obj: dict) -> tuple[str | None, str, bool]:
    """(answer text, analysis text, whether there is an answer member)."""
    answer, other, there = None, [], False
    for k, v in obj.items():
        if "answer" in str(k).lower() or str(k).lower() in ("antwort", "respuesta", "réponse"):
            there, answer = True, v
        elif v is not None:
            other.append(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
    return (answer if answer is None or isinstance(answer, str) else json.dumps(answer)), " ".join(other), there


RULES = {name: k + 1 for k, name in enumerate(DEFECTS)}


class _Pair:
    """What the rules look at."""

    def __init__(self, question: str | None, response: str | None, options: list[str] | None, predicted: str | None):
        self.question, self.options = (question or "").strip(), [o for o in options or [] if o]
        text = _INVISIBLE.sub("", response or "").strip()
        body, self.cut = _unwrap(text)
        self.body = body.strip()
        self.nothing = bool(_NOTHING.match(text) or _NOTHING.match(self.body) or _NOTHING.match(_LABEL.sub("", self.body)))
        obj, self.said, self.broken = None, self.body, False
        if self.body[:1] in "{[":
            try:
                obj = json.loads(self.body, strict=False)
            except ValueError:
                if not _balanced(self.body):
                    self.broken, self.said = True, _strings(self.body)
        if isinstance(obj, list) and len(obj) == 1 and isinstance(obj[0], dict):
            obj = obj[0]
        self.answer, self.analysis, self.blank = None, self.said, False
        if isinstance(obj, dict):
            self.answer, self.analysis, _ = _fields(obj)
            self.blank = self.answer is None or bool(_INVISIBLE.sub("", self.answer).strip().lower() in _BLANK_WORDS or _NOTHING.match(self.answer))
            if self.blank:
                self.answer = None
            self.said = f"{self.analysis} {self.answer or ''}".strip()
        #: plain text, whole or not
        self.plain = obj is None and not self.broken
        self.given = self.answer if self.answer is not None else self.said
        self.letter = bool(_LETTER_ONLY.match(self.answer or self.body)) or self.plain and bool(_CONCLUSION.search(self.body) or _LAST_LETTER.search(self.body))
        self.predicted = bool(predicted and _LETTER_ONLY.match(predicted))


def _hits(p: _Pair) -> dict[str, bool]:
    """Every rule that is triggered, and whether it makes the pair defective by itself (a rule may also
    show something beside another defect)."""
    if p.nothing:
        return {"empty": True}
    found: dict[str, bool] = {}
    if p.blank:
        found["empty"] = True
    ends = p.plain and not p.letter and not p.predicted and _breaks_off(p.body, p.question, p.options)
    if p.broken or p.cut or ends:
        found["truncated"] = True
    if p.question and not p.letter:
        if any(_copies(x, p.question, p.options) for x in {p.said, p.given, p.analysis}):
            found["copies_question"] = p.blank or _copies(p.given, p.question, p.options)
    if not p.letter and not (p.predicted and p.answer is not None) and _declines(p.said):
        found["refusal"] = not p.predicted
    if _foreign(p.question, p.analysis, p.answer or p.analysis, p.options):
        found["other_language"] = True
    return found


def _order(p: _Pair, found: dict[str, bool]) -> list[str]:
    """The decisive defect first: an unclosed wrapper says nothing else for sure; a blank answer is for
    want of one unless the text says why; a refusal that comes to its end is not truncated."""
    if p.broken:
        first = ("truncated",)
    elif p.blank:
        first = ("refusal", "copies_question", "empty")
    elif "truncated" in found and "refusal" in found and _END.search(p.body) and not _ELLIPSIS.search(p.body):
        first = ("copies_question", "refusal")
    else:
        first = ("copies_question",)
    order = [*first, *(d for d in DEFECTS if d not in first)]
    return sorted(found, key=lambda d: (not found[d], order.index(d)))


def defects(question: str | None, response: str | None, options: list[str] | None = None, predicted: str | None = None) -> list[str]:
    """Every defect of a pair, the decisive one first; [] if there is none.

    A null or blank question has no language and cannot be copied. Null options count as none, a null or
    unreadable prediction tells nothing."""
    p = _Pair(question, response, options, predicted)
    found = _hits(p)
    return _order(p, found) if any(found.values()) else []


def _strings(text: str) -> str:
    """What a JSON text that breaks off says: its strings that are no keys, the last one perhaps open."""
    parts = re.findall(r'"((?:[^"\\]|\\.)*)(?:"(\s*:)?|$)', text, re.S)
    return " ".join(re.sub(r'\\(["\\/])|\\[nrt]', lambda m: m[1] or " ", x) for x, key in parts if not key).strip()


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n", text) if s.strip()]


def _breaks_off(body: str, question: str, options: list[str]) -> bool:
    """A plain text that stops before its end, or before it comes to an answer."""
    n, ended = len(body.split()), bool(_END.search(body))
    opts = {_plain(_OPTION_MARK.sub("", o)) for o in options}
    is_option = any(_plain(_OPTION_MARK.sub("", x)) in opts for x in (body, body.splitlines()[-1]))  # or a list of options ends with one
    marked = bool(_OPTION_MARK.match(body)) and n <= 12
    if (_ELLIPSIS.search(body) or not ended) and not is_option and not marked and n > 5:
        return True
    if not ended:
        return not options and n > 8
    return not _answers(body, question, opts)


def _answers(body: str, question: str, opts: set[str]) -> bool:
    """Some sentence gives an answer: it states one, or begins with an option, or it does not just talk
    about the evidence and stands alone."""
    parts = _sentences(body)
    if question and parts and _plain(parts[0]) == _plain(question):
        parts = parts[1:]
    for s in parts:
        w = _plain(s).split()
        if _STATES.match(s) or any(o and " ".join(w[i:]).startswith(o) for o in opts for i in range(min(3, len(w)))):
            return True
    denied = any(f.search(low) and no.search(low) for s in parts for low in [s.casefold().replace("’", "'")] for f, no, _, _ in _REFUSALS)
    return not denied and len(parts) <= 1 and not any(_EVIDENCE.search(s) for s in parts)


def _declines(text: str) -> bool:
    """Some sentence refuses to answer."""
    for s in _sentences(text):
        low = s.casefold().replace("’", "'")
        if not s.isascii() and _REFUSALS_CJK.search(s):
            return True
        if not _MAY_REFUSE.search(low):
            continue
        for speaker, denial, speech, decline in _REFUSALS:
            if speaker.search(low) and (decline.search(low) or denial.search(low) and speech.search(low)):
                return True
    return False


def _foreign(question: str, analysis: str, given: str, options: list[str]) -> bool:
    text = f"{analysis} {given}" if given != analysis else given
    text = text.replace("’", "'")
    if not question:
        return False
    for o in sorted(options, key=len, reverse=True):
        text = text.replace(_OPTION_MARK.sub("", o), " ")
    text = _QUOTED.sub(" ", text)
    a, b = _script(question), _script(text)
    letters = sum(c.isalpha() for c in text)
    if a and b and a != b and letters >= 8:
        return True
    lang = language(question)
    if lang is None:
        return False
    low = text.casefold()
    tokens, alien = _TOKEN.findall(low), _alien(lang)
    votes = Counter(k for w in tokens if w in alien for k in alien[w])
    for k, cs in _LETTERS.items():
        if k != lang and (n := sum(low.count(c) for c in cs)):
            votes[k] += n
    for other, a in votes.items():
        if a >= (3 if other in _RARE else 2):
            theirs = _SETS[other]
            b = sum(w in _SETS[lang] and w not in theirs for w in tokens) + sum(low.count(c) for c in _LETTERS.get(lang, ""))
            if a > 1.5 * b:
                return True
    return False


@lru_cache(8)
def _alien(lang: str) -> dict[str, tuple[str, ...]]:
    """Function words that a language does not have, with the languages that do."""
    out: dict[str, tuple[str, ...]] = {}
    for k, ws in _SETS.items():
        for w in ws - _SETS[lang]:
            out[w] = (*out.get(w, ()), k)
    return out


def _language_marks(text: str) -> tuple[Counter, dict[str, int]]:
    """Words of a text with their number, and by language the number of letters that mark it."""
    low = text.casefold()
    return Counter(_TOKEN.findall(low)), {k: n for k, cs in _LETTERS.items() if (n := sum(low.count(c) for c in cs))}


_SCHEMA = "response_id bigint, rank int, rule_no int, defect string"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, n, RULES[d], d) for i, q, r, o, p in zip(*(b.column(k).to_pylist() for k in range(5))) for n, d in enumerate(defects(q, r, o, p))]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["response_id", "rank", "rule_no", "defect"])


def pair_defects(responses: DataFrame) -> DataFrame:
    """Every triggered defect of each row: response_id, rank (0 is decisive), rule_no (1 to 5), defect.

    ``responses``: response_id, question, response, options, predicted. Each row is judged alone, so
    repeated rows repeat their defects; an empty table gives an empty result; further columns are ignored.
    """
    return responses.select("response_id", "question", "response", "options", "predicted").mapInArrow(_batches, _SCHEMA)
