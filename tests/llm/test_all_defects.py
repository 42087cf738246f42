import pytest

from tideline.llm.pair_defects import defects

Q = "Where does the owl rest on the nest around 03:12?"
O = ["At the waterhole", "Near the den", "In the estuary", "It cannot be determined from the video"]


@pytest.mark.parametrize(
    "response, first, rest",
    [
        ('{"Analysis": "Das Bild ist unscharf, aber für die Entscheidung reicht es nicht und', "truncated", {"other_language"}),
        ('{"Analysis": "I\'m sorry, but I can\'t help with that. The frames', "truncated", {"refusal"}),
        (f'{{"Analysis": "{Q}', "truncated", {"copies_question"}),
        ('{"Analysis": "I must pass on this one.", "Answer": "N/A"}', "refusal", {"empty"}),
        ('{"Analysis": "Lo siento, no puedo ayudar con eso.", "Answer": ""}', "refusal", {"empty", "other_language"}),
        (Q.rstrip("?"), "copies_question", {"truncated"}),
        (Q, "copies_question", set()),
        (Q + "\n" + "\n".join(f"{x}. {o}" for x, o in zip("ABCD", O)), "copies_question", set()),
        ("", "empty", set()),
    ],
)
def test_every_rule_counts(response, first, rest):
    got = defects(Q, response, O)
    assert got[0] == first and set(got[1:]) == rest and len(got) == len(set(got))


def test_no_defect_stays_none():
    assert defects(Q, "B", O) == [] and defects(Q, '{"Analysis": "The den is in view.", "Answer": "B"}', O) == []
