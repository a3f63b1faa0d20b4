"""Deterministic stand-ins for a chat model, used by the registered checks
(no model weights exist here).  Each is a factory returning
``chat(system, user) -> str``, so ``generate`` builds it once per worker."""
from __future__ import annotations


def think_then_echo():
    """Reasoning in think tags, then the prompt itself."""
    return lambda system, user: "<think>" + system + "</think>\n" + user


def cite_first_block():
    """Answer citing the first context block of a user prompt."""
    def chat(system, user):
        for line in user.split("\n"):
            if line.startswith("["):
                return "According to " + line
        return "No context."
    return chat


def rule_judge_any():
    """Judge: full marks when the answer cites one of the expected sections,
    which the prompt joins by `` or ``."""
    one = rule_judge()

    def chat(system, user):
        head = "Expected BNS section: "
        line = next((x for x in user.split("\n") if x.startswith(head)), head)
        verdict = ""
        for section in line[len(head):].split(" or "):
            verdict = one(system, user.replace(line, head + section, 1))
            if '"citation": 1' in verdict:
                break
        return verdict
    return chat


def rule_judge():
    """Judge: full marks when the answer cites the expected section."""
    def chat(system, user):
        expected, answer, in_answer = "", [], False
        for line in user.split("\n"):
            if in_answer:
                answer.append(line)
            elif line.startswith("Expected BNS section: "):
                expected = line[len("Expected BNS section: "):]
            elif line == "Candidate answer:":
                in_answer = True
        if expected and ("[" + expected + " |") in "\n".join(answer):
            return '```json\n{"correctness": 5, "citation": 1, "reason": "cites the expected section"}\n```'
        return '{"correctness": 1, "citation": 0, "reason": "other section"}'
    return chat


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_encoder():
    """Encoder: how often each of a-z occurs in a text."""
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]
