"""Request wording.  Each builder returns a one-message list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.records import message, rendered
from corpusmill.functions.replies import OBJECTIVE_BY_GOAL


def _user(*parts: Column | str) -> Column:
    return F.array(message("user", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])))


def _contents(name: str) -> Column:
    return F.array_join(F.transform(name, lambda m: m["content"]), "\n")


def question_answer(text: Column) -> Column:
    return _user(
        "Write one question that the passage answers, the answer, and a passage excerpt, copied character for "
        "character, that proves the answer.\n\nPassage:\n",
        text,
        '\n\nReply with one JSON object with the string fields "question", "answer" and "supporting_quote".',
    )


def candidate_score(text: Column, question: Column, answer: Column) -> Column:
    return _user(
        "Score from 0 to 10 how well the answer follows from the passage.\n\nPassage:\n",
        text,
        "\n\nQuestion: ",
        question,
        "\n\nAnswer: ",
        answer,
        '\n\nReply with one JSON object with the numeric field "score".',
    )


def quality() -> Column:
    return _user(
        "Score from 0 to 10 how useful this example is for training a model.\n\nExample:\n",
        rendered(),
        '\n\nReply with one JSON object with the numeric field "score".',
    )


def preference() -> Column:
    return _user(
        "Score both answers from 0 to 10, each on its own.\n\nPrompt:\n",
        _contents("dpo_prompt"),
        "\n\nFirst answer:\n",
        _contents("chosen"),
        "\n\nSecond answer:\n",
        _contents("rejected"),
        '\n\nReply with one JSON object with the numeric fields "score_a" and "score_b".',
    )


def goal(sample: Column) -> Column:
    return _user(
        "Choose the training goal that suits this sample best, one of: " + ", ".join(OBJECTIVE_BY_GOAL) + ".\n\nSample:\n",
        sample,
        '\n\nReply with one JSON object with the string fields "goal", "rationale" and "desired_behavior".',
    )
