"""Notices that stand near a better one of the same phrase."""

import pytest

from framefold.llm import licenses


@pytest.mark.parametrize(
    "text, edits",
    [("mit licanse x mit license", [1, 0]), ("mit license mit licanse", [0, 1]), ("mit licanse mit licanse mit license mit licanse", [1, 1, 0, 1]), ("mit licanse mit license mit licanse mit license", [1, 0, 1, 0])],
)
def test_each_notice_of_a_window_is_found(text, edits):
    spans = [s for s in licenses.scan(text)[7] if s["phrase"] == "mit license"]
    assert [s["edits"] for s in spans] == edits and all(s["last_word"] == s["first_word"] + 1 for s in spans)
