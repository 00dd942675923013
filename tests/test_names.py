"""Every global name that the library's code uses exists, also in branches that no test runs."""

import builtins
import dis
import importlib
import pkgutil
import types

import voxelloom


def codes(code):
    yield code
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from codes(c)


def test_no_undefined_names():
    missing = []
    for info in pkgutil.walk_packages(voxelloom.__path__, "voxelloom."):
        if info.name.startswith("voxelloom.llm"):
            continue
        module = importlib.import_module(info.name)
        source = module.__spec__.loader.get_code(info.name)
        known = set(vars(module)) | set(dir(builtins))
        missing += [(info.name, i.argval) for c in codes(source) for i in dis.get_instructions(c) if i.opname == "LOAD_GLOBAL" and i.argval not in known]
    assert missing == []
