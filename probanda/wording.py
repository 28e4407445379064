"""Prompt wording.  Free to change: it instructs the user's generation function and
decides no stored value.  Pass your own ``Wording`` to the prompt builders."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Wording:
    system: str = "You answer from evidence. Weigh the evidence first and never state a guess as a fact."
    task: str = (
        "Answer the user's question directly, using nothing but the evidence listed under "
        "RETRIEVED_KNOWLEDGE. Where it falls short or contradicts itself, tell the reader."
    )
    ground: str = "Every statement needs support in the evidence listed below; add no outside facts."
    attribute: str = "Name the title of the source document behind each statement where you can."
    assumptions: str = "State these assumptions openly: %s."
    constraints: str = "Keep within these constraints: %s."
    confidence: str = (
        "The computed confidence is %s out of 1.0; quote no other figure, "
        "or describe how sure you are in words."
    )
    web: str = (
        "Items marked WEB are external and unverified and rank below LOCAL items; "
        "say so wherever a statement rests on one."
    )
    research_question: str = 'Research question: "%s"'
    research_rules: str = (
        "Combine the evidence above into one answer and point out where sources agree or differ. "
        "Cite a source as its exact name in square brackets and nothing else. LOCAL outranks WEB. "
        "If the evidence does not answer the question, say that and stop."
    )
    research_confidence: str = "The computed confidence is %s out of 1.0; quote no other figure."
    research_hedge: str = (
        'That is low: include a phrase such as "the evidence is limited", '
        '"I\'m not fully certain" or "this is unclear".'
    )
    summarize: str = "Condense the text below to no more than %d words and keep its key facts.\n\n%s"


DEFAULT_WORDING = Wording()
