"""A decoder of JVM class files, and Spark sources over directories and archives of them."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.patterns import last_rule_wins

MAX_CLASS_BYTES = 16_000_000
MAX_MAJOR = 69
_U2, _U4 = struct.Struct(">H"), struct.Struct(">I")
#: Bytes after the opcode, for opcodes with operands of fixed length.
_OPERANDS = {0x10: 1, 0x11: 2, 0x12: 1, 0x13: 2, 0x14: 2, **dict.fromkeys(range(0x15, 0x1A), 1), **dict.fromkeys(range(0x36, 0x3B), 1), 0x84: 2, **dict.fromkeys(range(0x99, 0xA9), 2), 0xA9: 1, **dict.fromkeys(range(0xB2, 0xB9), 2), 0xB9: 4, 0xBA: 4, 0xBB: 2, 0xBC: 1, 0xBD: 2, 0xC0: 2, 0xC1: 2, 0xC5: 3, 0xC6: 2, 0xC7: 2, 0xC8: 4, 0xC9: 4}
#: Access opcodes, and the kind of access they are.
_ACCESS = {0xB2: ("GETSTATIC", "FIELD_READ"), 0xB3: ("PUTSTATIC", "FIELD_WRITE"), 0xB4: ("GETFIELD", "FIELD_READ"), 0xB5: ("PUTFIELD", "FIELD_WRITE"), 0xB6: ("INVOKEVIRTUAL", "METHOD_CALL"), 0xB7: ("INVOKESPECIAL", "METHOD_CALL"), 0xB8: ("INVOKESTATIC", "METHOD_CALL"), 0xB9: ("INVOKEINTERFACE", "METHOD_CALL")}


class ClassFileError(ValueError):
    """The bytes are no class file that this decoder reads."""


@dataclass
class ClassFile:
    binary_name: str = ""
    superclass: str | None = None
    interfaces: list[str] = field(default_factory=list)
    access_flags: int = 0
    major: int = 0
    minor: int = 0
    source_file: str | None = None
    signature: str | None = None
    record: bool = False
    permitted: list[str] = field(default_factory=list)
    module: str | None = None
    requires: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    opens: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    provides: list[str] = field(default_factory=list)
    nesting: list[tuple] = field(default_factory=list)  # inner, outer, simple name, flags
    enclosing_class: str | None = None
    enclosing_method: str | None = None
    components: list[tuple] = field(default_factory=list)  # name, descriptor, signature
    constants: list[tuple] = field(default_factory=list)  # member, value
    defaults: list[tuple] = field(default_factory=list)  # member, value
    members: list[tuple] = field(default_factory=list)  # name, descriptor, flags, has_code, signature
    accesses: list[tuple] = field(default_factory=list)  # caller, owner, name, descriptor, kind, opcode, offset, line
    references: list[tuple] = field(default_factory=list)  # kind, member, class, offset, line
    annotations: list[tuple] = field(default_factory=list)  # subject, type, visible, target, elements (name, value)
    call_sites: list[tuple] = field(default_factory=list)  # caller, bootstrap owner, bootstrap name, offset


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ClassFileError("the file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return _U2.unpack(self.take(2))[0]

    def u4(self) -> int:
        return _U4.unpack(self.take(4))[0]


class _Pool:
    """The constant pool: entries by index, resolved on demand."""

    def __init__(self, r: _Reader) -> None:
        self.entries: dict[int, tuple] = {}
        n, i = r.u2(), 1
        while i < n:
            tag = r.u1()
            if tag == 1:
                self.entries[i] = (tag, r.take(r.u2()).decode("utf-8", "replace"))
            elif tag in (3, 4):
                self.entries[i] = (tag, r.take(4))
            elif tag in (5, 6):
                self.entries[i] = (tag, r.take(8))
                i += 1
            elif tag in (7, 8, 16, 19, 20):
                self.entries[i] = (tag, r.u2())
            elif tag in (9, 10, 11, 12, 17, 18):
                self.entries[i] = (tag, r.u2(), r.u2())
            elif tag == 15:
                self.entries[i] = (tag, r.u1(), r.u2())
            else:
                raise ClassFileError(f"constant tag {tag} isn't known")
            i += 1

    def get(self, index: int, *tags: int) -> tuple:
        entry = self.entries.get(index)
        if entry is None or tags and entry[0] not in tags:
            raise ClassFileError(f"constant {index} isn't what is asked for")
        return entry

    def text(self, index: int) -> str:
        return self.get(index, 1)[1]

    def name(self, index: int) -> str | None:
        """A class constant's name with dots; null for index 0."""
        return self.text(self.get(index, 7, 19, 20)[1]).replace("/", ".") if index else None

    def pair(self, index: int) -> tuple[str, str]:
        _, a, b = self.get(index, 12)
        return self.text(a), self.text(b)

    def ref(self, index: int) -> tuple[str, str, str]:
        _, owner, pair = self.get(index, 9, 10, 11)
        return self.name(owner), *self.pair(pair)


def _attributes(r: _Reader, pool: _Pool) -> Iterator[tuple[str, _Reader]]:
    for _ in range(r.u2()):
        name = pool.text(r.u2())
        yield name, _Reader(r.take(r.u4()))


#: Bytes of a type path's target before the path itself, by the first and last target type of a range: positions, bounds, offsets.
_TYPE_TARGETS = ((0x00, 0x01, 1), (0x10, 0x10, 2), (0x11, 0x12, 2), (0x13, 0x15, 0), (0x16, 0x16, 1), (0x17, 0x17, 2), (0x42, 0x42, 2), (0x43, 0x46, 2), (0x47, 0x4B, 3))


def _constant(pool: _Pool, index: int, tag: str = "") -> str:
    """A constant as text: numbers in decimal, booleans as true or false, characters as themselves."""
    kind, raw = pool.get(index)[:2]
    if kind == 1:
        return raw
    if kind == 8:
        return pool.text(raw)
    n = struct.unpack({3: ">i", 4: ">f", 5: ">q", 6: ">d"}[kind], raw)[0] if kind in (3, 4, 5, 6) else None
    if n is None:
        raise ClassFileError(f"constant {index} isn't a value")
    return ("true" if n else "false") if tag == "Z" else chr(n & 0xFFFF) if tag == "C" else repr(n)


def _element(r: _Reader, pool: _Pool, depth: int = 0) -> str:
    """An annotation element's value as text: lists in brackets, enum constants as type.name, classes and annotations by name."""
    if depth > 64:
        raise ClassFileError("annotation values are nested too deeply")
    tag = chr(r.u1())
    if tag in "BCDFIJSZs":
        return _constant(pool, r.u2(), tag)
    if tag == "c":
        return pool.text(r.u2())
    if tag == "e":
        return f"{_type_name(pool.text(r.u2()))}.{pool.text(r.u2())}"
    if tag == "@":
        name, elements = _annotation(r, pool, depth + 1)
        return f"@{name}(" + ", ".join(f"{e['name']}={e['value']}" for e in elements) + ")"
    if tag == "[":
        return "[" + ", ".join(_element(r, pool, depth + 1) for _ in range(r.u2())) + "]"
    raise ClassFileError(f"element tag {tag!r} isn't known")


def _type_name(descriptor: str) -> str:
    return descriptor[1:-1].replace("/", ".") if descriptor.startswith("L") else descriptor


def _annotation(r: _Reader, pool: _Pool, depth: int = 0) -> tuple[str, list[dict[str, str]]]:
    kind = _type_name(pool.text(r.u2()))
    return kind, [{"name": pool.text(r.u2()), "value": _element(r, pool, depth)} for _ in range(r.u2())]


def _annotations(subject: str, attribute: str, r: _Reader, pool: _Pool) -> list[tuple]:
    """(subject, type, visible, target, elements) of an annotation attribute; none for other attributes."""
    kind = attribute.removeprefix("RuntimeVisible").removeprefix("RuntimeInvisible")
    visible = attribute.startswith("RuntimeVisible")
    if kind == "Annotations":
        return [(subject, name, visible, "DECLARATION", elements) for _ in range(r.u2()) for name, elements in [_annotation(r, pool)]]
    if kind == "ParameterAnnotations":
        return [(f"{subject}:{k}", name, visible, "PARAMETER", elements) for k in range(r.u1()) for _ in range(r.u2()) for name, elements in [_annotation(r, pool)]]
    if kind == "TypeAnnotations":
        return [(subject, name, visible, "TYPE_USE", elements) for _ in range(r.u2()) for _ in [_skip_type_target(r)] for name, elements in [_annotation(r, pool)]]
    return []


def _skip_type_target(r: _Reader) -> None:
    target = r.u1()
    if target in (0x40, 0x41):  # local variables: a table of ranges
        r.take(6 * r.u2())
    else:
        found = [n for first, last, n in _TYPE_TARGETS if first <= target <= last]
        if not found:
            raise ClassFileError(f"type annotation target {target} isn't known")
        r.take(found[0])
    r.take(2 * r.u1())


def _code(out: ClassFile, member: str, r: _Reader, pool: _Pool, bootstraps: list[tuple[str, str]]) -> None:
    r.take(4)
    code = r.take(r.u4())
    for _ in range(r.u2()):
        r.take(6)
        caught = r.u2()
        if caught:
            out.references.append(("CAUGHT", member, pool.name(caught), None, None))
    lines: list[tuple[int, int]] = []
    for name, a in _attributes(r, pool):
        if name == "LineNumberTable":
            lines += [(a.u2(), a.u2()) for _ in range(a.u2())]
        else:
            out.annotations += _annotations(member, name, a, pool)
    lines.sort()

    def line(pc: int) -> int | None:
        found = [n for start, n in lines if start <= pc]
        return found[-1] if found else None

    at = 0
    while at < len(code):
        op, pc = code[at], at
        at += 1
        if op in (0xAA, 0xAB):  # switches: padded to four bytes
            at += -at % 4
            if op == 0xAA:
                low, high = struct.unpack(">ii", code[at + 4 : at + 12])
                at += 12 + 4 * (high - low + 1)
            else:
                at += 8 + 8 * _U4.unpack(code[at + 4 : at + 8])[0]
        elif op == 0xC4:  # wide
            at += 5 if code[at] == 0x84 else 3
        else:
            index = _U2.unpack(code[at : at + 2])[0] if _OPERANDS.get(op, 0) >= 2 else 0
            if op in _ACCESS:
                owner, name, descriptor = pool.ref(index)
                kind = "CONSTRUCTOR_CALL" if name == "<init>" else _ACCESS[op][1]
                out.accesses.append((member, owner, name, descriptor, kind, _ACCESS[op][0], pc, line(pc)))
            elif op == 0xBA:
                _, bootstrap, _ = pool.get(index, 18)
                owner, name = bootstraps[bootstrap] if bootstrap < len(bootstraps) else (None, None)
                out.call_sites.append((member, owner, name, pc))
            elif op in (0xBB, 0xBD, 0xC0, 0xC1, 0xC5):
                out.references.append(("INSTANCEOF" if op == 0xC1 else "TYPE_REFERENCE", member, pool.name(index), pc, line(pc)))
            elif op in (0x12, 0x13):
                i = code[at] if op == 0x12 else index
                if pool.entries.get(i, (0,))[0] == 7:
                    out.references.append(("CLASS_LITERAL", member, pool.name(i), pc, line(pc)))
            at += _OPERANDS.get(op, 0)


def decode(raw: bytes) -> ClassFile:
    """One class file; raises ClassFileError where it is damaged, too large or of an unknown version."""
    if len(raw) > MAX_CLASS_BYTES:
        raise ClassFileError("the file is too large")
    r = _Reader(raw)
    if r.take(4) != b"\xca\xfe\xba\xbe":
        raise ClassFileError("no class file")
    out = ClassFile(minor=r.u2(), major=r.u2())
    if not 45 <= out.major <= MAX_MAJOR:
        raise ClassFileError(f"version {out.major} isn't known")
    pool = _Pool(r)
    out.access_flags = r.u2()
    out.binary_name = pool.name(r.u2())
    out.superclass = pool.name(r.u2())
    out.interfaces = [pool.name(r.u2()) for _ in range(r.u2())]
    bodies: list[tuple[str, _Reader]] = []
    for is_method in (False, True):
        for _ in range(r.u2()):
            flags, name, descriptor = r.u2(), pool.text(r.u2()), pool.text(r.u2())
            member, has_code, signature = f"{out.binary_name}#{name}{descriptor}", False, None
            for attribute, a in _attributes(r, pool):
                if attribute == "Code" and is_method:
                    has_code = True
                    bodies.append((member, a))
                elif attribute == "Signature":
                    signature = pool.text(a.u2())
                elif attribute == "Exceptions":
                    out.references += [("THROWS", member, pool.name(a.u2()), None, None) for _ in range(a.u2())]
                elif attribute == "ConstantValue":
                    out.constants.append((member, _constant(pool, a.u2(), descriptor)))
                elif attribute == "AnnotationDefault":
                    out.defaults.append((member, _element(a, pool)))
                else:
                    out.annotations += _annotations(member, attribute, a, pool)
            out.members.append((name, descriptor, flags, has_code, signature))
    bootstraps: list[tuple[str, str]] = []
    for attribute, a in _attributes(r, pool):
        if attribute == "SourceFile":
            out.source_file = pool.text(a.u2())
        elif attribute == "Signature":
            out.signature = pool.text(a.u2())
        elif attribute == "Record":
            out.record = True
            for _ in range(a.u2()):
                name, descriptor, signature = pool.text(a.u2()), pool.text(a.u2()), None
                for inner, x in _attributes(a, pool):
                    if inner == "Signature":
                        signature = pool.text(x.u2())
                    else:
                        out.annotations += _annotations(f"{out.binary_name}#{name}", inner, x, pool)
                out.components.append((name, descriptor, signature))
        elif attribute == "InnerClasses":
            out.nesting = [(pool.name(a.u2()), pool.name(a.u2()), pool.text(i) if (i := a.u2()) else None, a.u2()) for _ in range(a.u2())]
        elif attribute == "EnclosingMethod":
            out.enclosing_class, i = pool.name(a.u2()), a.u2()
            out.enclosing_method = "".join(pool.pair(i)) if i else None
        elif attribute == "PermittedSubclasses":
            out.permitted = [pool.name(a.u2()) for _ in range(a.u2())]
        elif attribute == "BootstrapMethods":
            for _ in range(a.u2()):
                _, _, ref = pool.get(a.u2(), 15)
                bootstraps.append(pool.ref(ref)[:2])
                a.take(2 * a.u2())
        elif attribute == "Module":
            out.module = pool.name(a.u2())
            a.take(4)
            for _ in range(a.u2()):
                out.requires.append(pool.name(a.u2()))
                a.take(4)
            for names in (out.exports, out.opens):
                for _ in range(a.u2()):
                    names.append(pool.name(a.u2()))
                    a.take(2)
                    a.take(2 * a.u2())
            out.uses = [pool.name(a.u2()) for _ in range(a.u2())]
            for _ in range(a.u2()):
                out.provides.append(pool.name(a.u2()))
                a.take(2 * a.u2())
        else:
            out.annotations += _annotations(out.binary_name, attribute, a, pool)
    if r.at != len(raw):
        raise ClassFileError("bytes follow the class")
    for member, a in bodies:
        _code(out, member, a, pool, bootstraps)
    return out


# ---- sources ---------------------------------------------------------------------------------------

ENTRY = "container string, entry string, input_kind string, content binary, diagnostic string, multi_release boolean"


@dataclass(frozen=True)
class ArchiveLimits:
    """Bounds of what is unpacked: entries, bytes of one and of all, the packing ratio, and folders above an entry."""

    entries: int = 100_000
    entry_bytes: int = MAX_CLASS_BYTES
    total_bytes: int = 2_000_000_000
    ratio: int = 200
    depth: int = 64


MANIFEST = "META-INF/MANIFEST.MF"
#: Endings of archives that an archive may hold; they are not opened.
ARCHIVES = (".jar", ".zip", ".war", ".ear")
#: Entries, and bytes of content, that leave a task at a time.
BATCH_ENTRIES, BATCH_CONTENT = 256, 8_000_000


def parse_manifest(text: str) -> dict[str, str]:
    """The main attributes of a manifest, names in lower case; a line that begins with a space goes on with the one before."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.partition("\n\n")[0].replace("\n ", "")
    return {name.strip().lower(): value.strip() for name, colon, value in (x.partition(":") for x in lines.split("\n")) if colon}


def read_manifest(archive: zipfile.ZipFile, limit: int = 1_000_000) -> dict[str, str]:
    """Nothing where the archive has no manifest, or one beyond ``limit`` bytes."""
    info = next((i for i in archive.infolist() if i.filename.upper() == MANIFEST.upper()), None)
    return parse_manifest(archive.read(info).decode("utf-8", "replace")) if info and info.file_size <= limit else {}


def archive_entries(name: str, raw: bytes, limits: ArchiveLimits) -> Iterator[tuple]:
    """Class entries of one archive in order of name, one at a time; what breaks a bound becomes a diagnostic.

    So do archives within the archive, which are not opened, and an entry whose name came before: the first one stands.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
        multi_release = read_manifest(archive).get("multi-release", "").lower() == "true"
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
        yield name, None, "JAR", None, f"ARCHIVE_DAMAGED {e}", None
        return
    row = lambda path, content, said: (name, path, "JAR", content, said, multi_release)
    total, before = 0, None
    for k, info in enumerate(sorted(archive.infolist(), key=lambda i: i.filename)):
        if k >= limits.entries:
            yield row(None, None, "ENTRY_LIMIT")
            return
        path = info.filename
        repeated, before = path == before, path
        if path.lower().endswith(ARCHIVES):
            yield row(path, None, "NESTED_ARCHIVE")
        if not path.endswith(".class"):
            continue
        if repeated:
            yield row(path, None, "REPEATED_ENTRY")
        elif path.startswith("/") or "\\" in path or ".." in path.split("/"):
            yield row(path, None, "ENTRY_PATH")
        elif path.count("/") > limits.depth:
            yield row(path, None, "ENTRY_DEPTH")
        elif info.file_size > limits.entry_bytes or info.file_size > limits.ratio * max(info.compress_size, 1):
            yield row(path, None, "ENTRY_SIZE")
        else:
            total += info.file_size
            if total > limits.total_bytes:
                yield row(path, None, "TOTAL_SIZE")
                return
            try:
                yield row(path, archive.read(info), None)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                yield row(path, None, f"ENTRY_DAMAGED {e}")


def _in_batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """``rows`` of entries in lists of a bounded size, so that no archive is held unpacked as a whole."""
    held: list[tuple] = []
    content = 0
    for row in rows:
        held.append(row)
        content += len(row[3] or b"")
        if len(held) >= BATCH_ENTRIES or content >= BATCH_CONTENT:
            yield held
            held, content = [], 0
    if held:
        yield held


def manifest_class_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, place, entry): the Class-Path entries of the archives at ``paths``, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    entries = read_manifest(zipfile.ZipFile(io.BytesIO(raw.as_py()))).get("class-path", "").split()
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                    entries = []
                rows += [(name, k, e) for k, e in enumerate(entries)]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "place", "entry"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, place int, entry string")


def follow_manifests(spark: SparkSession, inputs: list[tuple[str, str]], *, max_depth: int = 8, max_entries: int = 1_000) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(inputs with what their manifests' class paths name behind each of them, diagnostics (path, text)).

    An entry must be a relative path that stays in the folder of the input it comes from.  Manifests are read a depth at a
    time; a depth, or a number of entries, beyond the bounds is a diagnostic.
    """
    is_jar = lambda kind, path: kind == "JAR" or kind == "AUTO" and path.endswith((".jar", ".zip"))
    named: dict[str, list[str]] = {}
    said: list[tuple[str, str]] = []
    roots = {path: posixpath.dirname(posixpath.abspath(path)) for kind, path in inputs if is_jar(kind, path)}
    wave, depth, followed, spent = dict(roots), 0, 0, False
    while wave and depth < max_depth and not spent:
        entries: dict[str, list[str]] = {path: [] for path in wave}
        by_uri = {posixpath.abspath(path): path for path in wave}
        for r in manifest_class_paths(spark, sorted(wave)).orderBy("path", "place").limit(max_entries + 1).collect():
            path = by_uri[posixpath.abspath(re.sub(r"^file:/+", "/", r["path"]))]
            if followed >= max_entries:
                said.append((path, f"CLASS_PATH_TOO_LONG {max_entries}"))
                spent = True
                break
            followed += 1
            to = posixpath.normpath(posixpath.join(posixpath.dirname(posixpath.abspath(path)), r["entry"]))
            if ":" in r["entry"] or r["entry"].startswith("/") or not to.startswith(f"{wave[path]}/"):
                said.append((path, f"CLASS_PATH_LEADS_OUT {r['entry']}"))
            else:
                entries[path].append(to)
        named |= entries
        there = {to: wave[path] for path, found in entries.items() for to in found if to.endswith((".jar", ".zip"))}
        wave, depth = {to: root for to, root in there.items() if to not in named and posixpath.exists(to)}, depth + 1
    said += [(path, f"CLASS_PATH_TOO_DEEP {max_depth}") for path in sorted(wave) if not spent]
    out: list[tuple[str, str]] = []
    placed: set[str] = set()

    def place(kind: str, path: str) -> None:
        out.append((kind, path))
        if path in named and path not in placed:
            placed.add(path)
            for to in named[path]:
                if posixpath.exists(to):
                    place("JAR" if to.endswith((".jar", ".zip")) else "DIRECTORY", to)
                else:
                    said.append((path, f"CLASS_PATH_ABSENT {to}"))

    for kind, path in inputs:
        place(kind, path)
    return out, said


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Class files below a directory, as entries."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.class").load(path)
    return rows.select(F.lit(path).alias("container"), F.col("path").alias("entry"), F.lit("DIRECTORY").alias("input_kind"), "content", F.lit(None).cast("string").alias("diagnostic"), F.lit(None).cast("boolean").alias("multi_release"))


def read_jars(spark: SparkSession, path: str, limits: ArchiveLimits | None = None) -> DataFrame:
    """Class entries of all archives below a path."""
    limits = limits or ArchiveLimits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_())
        names = ["container", "entry", "input_kind", "content", "diagnostic", "multi_release"]
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in _in_batches(archive_entries(name, raw.as_py(), limits)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jar").load(path)
    return rows.select("path", "content").mapInArrow(run, ENTRY)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_inputs(spark: SparkSession, inputs: list[tuple[str, str]], *, manifests: bool = False, ignore: list[tuple[str, str]] | None = None) -> DataFrame:
    """Entries of (kind, path) inputs, kind DIRECTORY, JAR or AUTO, with the input's precedence.

    A repeated input counts once and leaves a diagnostic, and so does one that isn't there.  ``manifests`` follows the class paths of archives' manifests;
    ``ignore`` has the rules of an ignore file, over the entries' paths below their container.
    """
    said: list[tuple[str, str]] = []
    if manifests:
        inputs, said = follow_manifests(spark, inputs)
    out, seen = None, set()
    for precedence, (kind, path) in enumerate(inputs):
        if path in seen:
            said.append((path, "DUPLICATE_INPUT"))
            continue
        seen.add(path)
        if not _exists(spark, path):
            said.append((path, "INPUT_ABSENT"))
            continue
        jar = kind == "JAR" or kind == "AUTO" and path.endswith((".jar", ".zip"))
        part = (read_jars if jar else read_directory)(spark, path).withColumn("precedence", F.lit(precedence))
        out = part if out is None else out.unionByName(part)
    if out is None:
        if not inputs:
            raise ValueError("no input is given")
        out = spark.createDataFrame([], f"{ENTRY}, precedence int")
    if ignore:
        below = F.expr("substring(entry, locate(container, entry) + length(container))")
        place = F.when(F.col("input_kind") == "DIRECTORY", F.ltrim(below, F.lit("/"))).otherwise(F.col("entry"))
        out = out.where(F.col("entry").isNull() | ~last_rule_wins(place, ignore))
    if said:
        notes = spark.createDataFrame([(path, text) for path, text in said], "container string, diagnostic string")
        out = out.unionByName(notes.withColumns({"input_kind": F.lit("INPUT"), "precedence": F.lit(len(inputs))}), allowMissingColumns=True)
    return out


DECODED = (
    "container string, entry string, input_kind string, precedence int, multi_release boolean, binary_name string, superclass string, interfaces array<string>, access_flags int, major int, source_file string, signature string, record boolean,"
    " permitted array<string>, module string, requires array<string>, exports array<string>, opens array<string>, uses array<string>, provides array<string>,"
    " enclosing_class string, enclosing_method string, nesting array<struct<inner:string,outer:string,name:string,flags:int>>,"
    " components array<struct<name:string,descriptor:string,signature:string>>, constants array<struct<member:string,value:string>>, defaults array<struct<member:string,value:string>>,"
    " members array<struct<name:string,descriptor:string,flags:int,has_code:boolean,signature:string>>,"
    " accesses array<struct<caller:string,owner:string,name:string,descriptor:string,kind:string,opcode:string,offset:int,line:int>>,"
    " references array<struct<kind:string,member:string,class:string,offset:int,line:int>>, annotations array<struct<subject:string,type:string,visible:boolean,target:string,elements:array<struct<name:string,value:string>>>>,"
    " call_sites array<struct<caller:string,owner:string,name:string,offset:int>>, diagnostic string"
)


def decode_entries(entries: DataFrame) -> DataFrame:
    """Decoded classes; an entry that fails keeps its row with a diagnostic, and never fails the job."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DECODED))
    names = [f.name for f in schema]
    fields = {f.name: [x.name for x in f.type.value_type] for f in schema if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for container, entry, kind, precedence, raw, why, multi_release in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                row = dict.fromkeys(names) | {"container": container, "entry": entry, "input_kind": kind, "precedence": precedence, "diagnostic": why, "multi_release": multi_release}
                if raw is not None:
                    try:
                        c = vars(decode(raw))
                        row |= {k: [dict(zip(fields[k], x, strict=True)) for x in c[k]] if k in fields else c[k] for k in names if k in c}
                    except (ClassFileError, struct.error, IndexError, KeyError, UnicodeDecodeError) as e:
                        row["diagnostic"] = f"CLASS_DAMAGED {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return entries.select("container", "entry", "input_kind", F.col("precedence").cast("int"), "content", "diagnostic", "multi_release").mapInArrow(run, DECODED)


