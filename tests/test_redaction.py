"""Redaction is a fixed point."""

import pytest

from tidemark.functions import pii


@pytest.mark.parametrize("text", ["Im " * 8 + "verteer verteer", "Im " * 9, "my name is Anna\tLarsen", "call me Jo Doe call me Jo Doe"])
def test_redaction_of_redacted_text_changes_nothing(text):
    out, counts = pii.redact_text(text)
    assert pii.redact_text(out) == (out, {})
    assert "Larsen" not in out and "Doe" not in out and counts["PERSON"] == out.count("[PERSON]")
