"""Wordings that the rules were not written after, in several languages."""

import pytest

from tideline.llm.pair_defects import defects

Q = "Where does the owl rest on the nest around 03:12?"
QD = "Was macht der Förster am Waldrand gegen 12:40 Uhr?"
O = ["At the waterhole", "Near the den", "In the estuary", "Under the bridge"]

REFUSALS = [
    "I won't be answering this one.", "That is a question I must leave to others.", "Sorry, I'd have to skip this.", "I would rather not get into that.", "It is not something I can comment on.", "We are not permitted to judge people in recordings.", "Answering that would go against my instructions.",
    "Nein, das beantworte ich nicht.", "Dazu werde ich keine Auskunft geben.", "Ich verzichte lieber auf eine Antwort.", "Tut mir leid, da helfe ich nicht weiter.",
    "No quiero responder a eso.", "Prefiero abstenerme de dar una respuesta.", "Je refuse de répondre à cette demande.", "Je ne souhaite pas commenter cette scène.",
    "Non posso rispondere a questa domanda.", "Prefiro não responder a essa pergunta.", "Daar kan ik geen antwoord op geven.", "Nie mogę odpowiedzieć na to pytanie.", "Jag kan tyvärr inte svara på den frågan.", "Я не могу ответить на этот вопрос.",
    "申し訳ありませんが、その質問にはお答えできません。", "抱歉,我无法回答这个问题。", "죄송하지만 답변할 수 없습니다.",
]
ANSWERS = [
    "I can see the owl near the den, so the answer is B.", "The water is not visible, but the den is. Answer: B", "Nobody answers the phone in the video. I choose C.", "It is not the waterhole. The answer is D.", "That's near the den.", "Near the den, next to a tree.", "The judge refuses to answer the lawyer. Therefore the answer is A.",
    "{\"analysis\": \"I could not read the sign, but the owl sits near the den.\", \"answer\": \"B\"}", "My guess would be B.",
]
FOREIGN = [
    "De uil zit op het nest bij het water en dat is hier goed te zien.", "Sowa siedzi na gnieździe przy wodzie, co dobrze widać na obrazie.", "Ugglan sitter på boet vid vattnet och det syns i bilden.", "Baykuş su kenarında yuvada duruyor ve bu görüntü açık.", "Сова сидит на гнезде у воды.", "フクロウは水辺の巣にいます。", "La civetta è sul nido vicino al fiume, come si vede nella scena.",
]


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    got = defects(Q, text, O)
    assert "refusal" in got
    english = text.isascii() and text in REFUSALS[:7]
    assert english or "other_language" in got or len(text.split()) < 9


@pytest.mark.parametrize("text", ANSWERS)
def test_answers(text):
    assert defects(Q, text, O) == []


@pytest.mark.parametrize("text", FOREIGN)
def test_foreign(text):
    assert "other_language" in defects(Q, text, O) and "other_language" in defects(QD, text, O)


def test_german_answer_to_a_german_question():
    assert defects(QD, "Das ist der Förster, er sägt einen Baum ab.", ["A. Er sägt", "B. Er schläft"]) == []
    assert defects(QD, "Ich kann das Schild nicht lesen, aber der Förster sägt. Die Antwort ist A.", ["A. Er sägt", "B. Er schläft"]) == []


def test_prediction_counts():
    """A letter was read out of the response: it holds an answer."""
    text = "After some thought the second place it shall be, as the tree hides the rest of the picture"
    assert defects(Q, text, O)[:1] == ["truncated"]
    assert defects(Q, text, O, "B") == [] == defects(Q, text, O, " (b) ")
    assert defects(Q, text, O, "n/a")[:1] == ["truncated"]


def test_rules_do_not_hide_each_other():
    text = "Es tut mir leid, dazu kann ich nichts sagen, und deshalb werde ich diese Frage nicht beantworten weil"
    assert set(defects(Q, text, O)) == {"truncated", "refusal", "other_language"}
