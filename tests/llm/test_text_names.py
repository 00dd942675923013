"""Every global name that the text operators use exists."""

import builtins
import dis
import importlib
import pkgutil

import voxelloom.llm
from tests.test_names import codes


def test_no_undefined_names():
    missing = []
    for info in pkgutil.walk_packages(voxelloom.llm.__path__, "voxelloom.llm."):
        module = importlib.import_module(info.name)
        known = set(vars(module)) | set(dir(builtins))
        missing += [(info.name, i.argval) for c in codes(module.__spec__.loader.get_code(info.name)) for i in dis.get_instructions(c) if i.opname == "LOAD_GLOBAL" and i.argval not in known]
    assert missing == []
