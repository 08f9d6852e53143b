import pytest

pytest.importorskip("marlstone.llm.common")
