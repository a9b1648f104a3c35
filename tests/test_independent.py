import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_the_core_does_not_import_the_subpackage():
    for p in (ROOT / "corpuscle").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"corpuscle\.llm|from \.+llm", p.read_text()), p
