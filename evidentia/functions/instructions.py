"""What a judge is told before a prompt, for each mode, and the form of its answers."""

from __future__ import annotations

_COMMON = (
    "You review source code for security. You are shown one function or route with what static analysis found around it, and nothing else of the program. "
    "Judge only what is shown: cite line numbers that you can see, and don't invent callers, configuration or data. "
    "Report a finding only if a concrete attacker could use it; if nothing of the kind is there, answer with an empty list. "
    "For each finding give a type, a CWE number, severity, confidence, the lines, a short title, what is wrong, why the surrounding code matters, and a fix."
)
#: Instructions by mode.
SYSTEM = {
    "injection": _COMMON + " Look for input of an attacker that reaches a dangerous call without being made safe on the way. Follow the data-flow paths and the callers: "
    "say where the input enters, how it gets to the call, and why no check or encoding on that way stops it. Constants and values that only the program itself makes are no input of an attacker.",
    "absence": _COMMON + " Look for an operation that needs a control and has none: authentication, authorization, ownership of the object, a valid session, or validation of what is written. "
    "The guard evidence lists every check that analysis found on the function, on its route and in its callers; an empty list is the signal. A check on the route or in a caller counts. "
    "Routes that are public by their nature (signing in, health, static files) need none. Name the control that is required and why it is missing.",
    "hygiene": _COMMON + " Look for unsafe practice that needs no input of an attacker: secrets in the code, weak hashes or ciphers, random numbers that can be guessed, verification that is switched off, debugging left on. "
    "Placeholders, examples, tests and values read from the environment are none.",
}

_TEXT = {"type": "string"}


def answer_schema(mode: str) -> dict:
    """JSON schema of an answer: closed objects, with the words that severity and confidence may be."""
    from .fixed import CONFIDENCES, SEVERITIES

    fields = {
        "vulnerability_type": _TEXT, "cwe": _TEXT, "severity": {"enum": list(SEVERITIES)}, "confidence": {"enum": list(CONFIDENCES)}, "start_line": {"type": "integer"}, "end_line": {"type": "integer"},
        "title": _TEXT, "description": _TEXT, "suggested_fix": _TEXT,
    }
    fields |= {"operation_class": _TEXT, "required_control": _TEXT, "missing_control_reasoning": _TEXT} if mode == "absence" else {"context_reasoning": _TEXT, "data_flow_summary": _TEXT}
    item = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"findings": {"type": "array", "items": item}}, "required": ["findings"], "additionalProperties": False}
