import pytest

pytest.importorskip("tallyloom.llm")
