import pytest

from tideline.llm.pair_defects import defects, pair_defects

Q = "Where does the owl rest on the nest around 03:12?"
O = ["At the waterhole", "Near the den", "In the estuary", "It cannot be determined from the video"]

CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \n​ ", "empty"), (Q, "N/A", "empty"), (Q, "null", "empty"), (Q, "...", "empty"), (Q, "[]", "empty"), (Q, "```json\n```", "empty"), (Q, "Answer:", "empty"),
    (Q, '{"Analysis": "The nest is in view.", "Answer": "  "}', "empty"), (Q, '{"Answer": null}', "empty"), (Q, '```json\n{"Analysis": "", "Answer": ""}\n```', "empty"), (Q, "{}", "empty"),
    (Q, '{"Analysis": "The nest is in vi', "truncated"), (Q, '```json\n{"Analysis": "The nest is in view. ', "truncated"), (Q, "No frame supports option A. The frames cannot show the", "truncated"),
    (Q, "The caption speaks of the nest and the owl tog…", "truncated"), (Q, "Options A and B can be ruled out because nothing like that appears. The answer is", "truncated"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "My guidelines rule out a reply here for safety reasons!", "refusal"), (Q, '{"Analysis": "I must pass on this one.", "Answer": "N/A"}', "refusal"),
    ("Was ist am Ufer zu sehen?", "Dazu möchte ich mich nicht äußern und bitte um Verständnis.", "refusal"), ("¿Qué se ve en la charca?", "Lo siento, no puedo ayudar con eso.", "refusal"), ("Que regarde une loutre vers 03:12 ?", "Désolé, je ne peux fournir aucune réponse.", "refusal"),
    (Q, Q, "copies_question"), (Q, f"{Q} {Q}", "copies_question"), (Q, f"You asked: {Q}", "copies_question"), (Q, Q.upper().rstrip("?"), "copies_question"), (Q, Q.replace("rest", "rset"), "copies_question"),
    (Q, Q + "\n" + "\n".join(f"{l}. {o}" for l, o in zip("ABCD", O)), "copies_question"), (Q, f'{{"Analysis": "{Q}", "Answer": "{Q}"}}', "copies_question"), (Q, f'```json\n{{"Answer": "{Q[:-1]}."}}\n```', "copies_question"),
    (Q, "Das Bild ist unscharf, aber für die Entscheidung reicht es. Antwort: D", "other_language"), (Q, "选项A和B可以排除。画面清楚地显示了这一动作。 答案:D", "other_language"), (Q, '{"Analysis": "La imagen está borrosa, pero basta para decidir.", "Answer": "B"}', "other_language"),
    ("Was ist am Ufer zu sehen, wenn der Fuchs ins Bild kommt?", "No frame supports option A. The answer is C.", "other_language"),
    (Q, "B", None), (Q, "(C)", None), (Q, "b.", None), (Q, "A. At the waterhole", None), (Q, "In the estuary", None), (Q, "It cannot be determined from the video.", None), (Q, f"{Q} Near the den.", None),
    (Q, 'It is "Near the den", as shown near 03:12.', None), (Q, "I can't read the plate, though the owl is easy to tell apart. Therefore I choose B.", None), (Q, "Somebody off screen declines to answer, which does not change the picture: Near the den. Answer: B", None),
    (Q, '```json\n{\n  "Analysis": "A sign reads \'Ausfahrt freihalten\', which does not matter here.",\n  "Answer": "A"\n}\n```', None), ("¿Qué aparece?", "Se trata de el sofrito.", None), ("", "The answer is C.", None), (None, "C", None),
]


@pytest.mark.parametrize("q, r, want", CASES)
def test_cases(q, r, want):
    got = defects(q, r, O)
    assert (got[0] if got else None) == want


def test_table(spark):
    rows = [(1, Q, None, O, None), (2, Q, "B", None, "B"), (3, None, None, [None], None), (4, Q, "x " * 100_000 + ".", O, None), (1, Q, None, O, None), (None, Q, "", O, None)]
    schema = "response_id bigint, question string, response string, options array<string>, predicted string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as rule_no", "'d' as defect")
    got = sorted(tuple(r) for r in pair_defects(df).where("defect = 'empty'").select("response_id").collect() if r[0] is not None)
    assert got == [(1,), (1,), (3,)]
    assert pair_defects(spark.createDataFrame([], schema)).count() == 0
