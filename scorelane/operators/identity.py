"""What tells one piece of code from another: its instructions, constants and what it carries along."""

from __future__ import annotations

import functools
import hashlib
import sys
import sysconfig
import types
from pathlib import Path

from pyspark.cloudpickle import dumps

_PLAIN = (str, bytes, int, float, complex, bool, type(None), type(Ellipsis))
_LIBRARIES = tuple(
    str(Path(sysconfig.get_paths()[name]).resolve()) for name in ("stdlib", "purelib", "platlib")
)


def _of_library(name: str | None) -> bool:
    """Whether a module is Python's or an installed package's, whose name and version will do."""
    module = sys.modules.get(name or "")
    file = getattr(module, "__file__", None)
    if file is None:
        return module is not None and name != "__main__"
    return str(Path(file).resolve()).startswith(_LIBRARIES)


def _names(code: types.CodeType) -> set[str]:
    """The global names that a function and those inside it may read."""
    found = set(code.co_names)
    for constant in code.co_consts:
        if isinstance(constant, types.CodeType):
            found |= _names(constant)
    return found


def code_digest(value: object) -> str:
    """A digest of a function's code and of all that it reaches by closure, default or global name.

    It does not depend on where the code lies, nor on whether its module can be
    imported, so a moved script keeps its digest and a changed body does not. Of
    installed packages the version counts, not the code.
    """
    digest = hashlib.sha256()
    seen: dict[int, int] = {}

    def put(*parts: object) -> None:
        for part in parts:
            digest.update(f"{part}\0".encode("utf-8", "backslashreplace"))

    def walk(x: object) -> None:
        if isinstance(x, _PLAIN):
            put(type(x).__name__, repr(x))
            return
        if id(x) in seen:
            put("seen", seen[id(x)])
            return
        seen[id(x)] = len(seen)
        if isinstance(x, types.CodeType):
            put("code", x.co_name, x.co_code.hex(), x.co_argcount, x.co_flags, *x.co_names, *x.co_varnames)
            walk(x.co_consts)
        elif isinstance(x, types.FunctionType):
            put("function", x.__qualname__)
            if _of_library(x.__module__):
                walk(sys.modules[x.__module__.partition(".")[0]])
                return
            walk((x.__code__, x.__defaults__, x.__kwdefaults__))
            walk(tuple(cell.cell_contents for cell in x.__closure__ or ()))
            for name in sorted(_names(x.__code__) & x.__globals__.keys()):
                put("global", name)
                walk(x.__globals__[name])
        elif isinstance(x, types.MethodType):
            walk((x.__func__, x.__self__))
        elif isinstance(x, functools.partial):
            walk((x.func, x.args, x.keywords))
        elif isinstance(x, types.ModuleType):
            put("module", x.__name__, getattr(x, "__version__", ""))
        elif isinstance(x, type):
            put("class", x.__qualname__)
            if _of_library(x.__module__):
                put(x.__module__)
            else:
                skipped = ("__dict__", "__weakref__", "__module__", "__doc__", "__firstlineno__")
                walk({k: v for k, v in vars(x).items() if k not in skipped})
                walk(x.__bases__)
        elif isinstance(x, dict):
            put("dict", len(x))
            for key in sorted(x, key=repr):
                walk(key)
                walk(x[key])
        elif isinstance(x, (tuple, list)):
            put(type(x).__name__, len(x))
            for item in x:
                walk(item)
        elif isinstance(x, (set, frozenset)):
            put("set", len(x))
            for item in sorted(x, key=repr):
                walk(item)
        elif isinstance(x, (staticmethod, classmethod)):
            walk(x.__func__)
        elif isinstance(x, property):
            walk((x.fget, x.fset, x.fdel))
        elif not _of_library(type(x).__module__) and hasattr(x, "__dict__"):
            walk((type(x), vars(x)))
        elif isinstance(x, (types.BuiltinFunctionType, types.MemberDescriptorType, types.GetSetDescriptorType)):
            put("builtin", x.__qualname__)
        else:
            put(type(x).__qualname__, hashlib.sha256(dumps(x)).hexdigest())

    walk(value)
    return digest.hexdigest()
