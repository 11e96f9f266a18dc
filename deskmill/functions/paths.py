"""What a path in an export tells: object type, object name, module kind, form or command."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskmill.functions import fixed as X


def glob_pattern(glob: str) -> str:
    """Java pattern of a file glob with *, ? and [sets], in lower case."""
    out, rest = "", glob.lower()
    while rest:
        m = re.match(r"\[(!?)([^\]]+)\]", rest)
        if m:
            out += "[" + ("^" if m.group(1) else "") + m.group(2).replace("\\", "\\\\").replace("^", "\\^") + "]"
            rest = rest[m.end():]
            continue
        out += {"*": ".*", "?": "."}.get(rest[0], re.escape(rest[0]))
        rest = rest[1:]
    return "(?s)^" + out + r"\z"


def exclude_reason(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Reason of the first rule that matches the file name or the whole path; null when the file is kept."""
    name, whole = F.lower(F.substring_index(path, "/", -1)), F.lower(path)
    hits = [F.when(name.rlike(glob_pattern(g)) | whole.rlike(glob_pattern(g)), F.lit(reason)) for g, reason in rules]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _after(parts: Column, word: str) -> Column:
    """The part behind ``word`` if it is not the last one."""
    at = F.array_position(parts, word).cast("int")
    return F.when((at > 0) & (at + 1 < F.size(parts)), F.get(parts, at))


def path_meta(path: Column, kinds=None, code_suffix: str = ".bsl") -> Column:
    """struct(object_type, object_name, module_kind, sub_name) by the folder dictionary."""
    kinds = X.OBJECT_KINDS if kinds is None else kinds
    types = F.create_map(*[F.lit(x) for folder, _, shown in kinds for x in (folder, shown)])
    modules = F.create_map(*[F.lit(x) for kv in X.MODULE_KINDS.items() for x in kv])
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    bare = F.regexp_replace(file, r"\.[^.]*$", "")
    code = F.lower(path).endswith(code_suffix)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    known = F.transform(folders, lambda p: p.isin([k[0] for k in kinds]))
    at = F.array_position(known, F.lit(True)).cast("int")
    folder = F.get(parts, at - 1)
    name = F.when(at + 1 == F.size(parts), bare).otherwise(F.get(parts, at))
    rest = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    form, command = _after(rest, "Forms"), _after(rest, "Commands")
    by_name = F.try_element_at(modules, F.lower(bare))
    module = (F.when(form.isNotNull(), "МодульФормы").when(command.isNotNull(), "МодульКоманды")
              .when(by_name.isNotNull(), by_name).when(folder == "CommonModules", "ОбщийМодуль")
              .when(folder == "CommonForms", "МодульФормы").when(folder.isin("WebServices", "HTTPServices"), "МодульСервиса")
              .otherwise("Модуль"))
    inside = at > 0
    return F.struct(
        F.when(inside, F.try_element_at(types, folder)).otherwise("Конфигурация").alias("object_type"),
        F.when(inside, name).otherwise("").alias("object_name"),
        F.when(~inside, F.coalesce(by_name, F.when(code, "Модуль").otherwise("Структура")))
        .when(code, module).otherwise("Структура").alias("module_kind"),
        F.when(inside & code, F.coalesce(form, command, F.lit(""))).otherwise("").alias("sub_name"))


def is_object_file(path: Column, kinds=None) -> Column:
    """Description of an object in either export layout (no forms, rights or templates)."""
    kinds = X.OBJECT_KINDS if kinds is None else kinds
    folders = [k[0] for k in kinds if k[0] not in X.FOLDERS_WITHOUT_STRUCTURE]
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    flat = F.lower(file).endswith(".xml") & F.coalesce(F.get(parts, F.size(parts) - 2).isin(folders), F.lit(False))
    nested = (F.lower(file).endswith(".mdo") & F.coalesce(F.get(parts, F.size(parts) - 3).isin(folders), F.lit(False))
              & F.coalesce(F.get(parts, F.size(parts) - 2) == F.regexp_replace(file, r".{4}$", ""), F.lit(False)))
    return flat | nested
