import pytest

pytest.importorskip("tessera.llm")
