"""Dependencies declared or locked in manifests, as rows.

Each format is a function from text to declarations; what is common to all (names, versions, where
a dependency comes from, package URLs) is settled once, in ``items``. Formats are nested documents,
so they are parsed in Python, one file at a time, in Arrow batches; files are chosen by name in
the JVM first. A file that cannot be read as its format gives no rows and the status ``partial``.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.scalars import basename
from cipherlake.sources.tables import written


class Declared(NamedTuple):
    """A dependency as a manifest has it. kind: where it stands (manifest, manifest_dev, ..., lock)."""

    name: str
    version: str | None = None
    kind: str = "manifest"
    source: str | None = None  # a place other than the ecosystem's registry
    line: int = 0


#: Package-URL types of the ecosystems.
ECOSYSTEMS = ("cargo", "npm", "pypi", "gem", "maven", "golang", "generic")
#: Items of a file at most; a file with more is marked as truncated.
MOST_ITEMS = 10_000
#: Parents above a project file at most.
MOST_LEVELS = 16
_TOKEN = r"[A-Za-z0-9._+-]+"
_NAMES = {"npm": re.compile(rf"(@{_TOKEN}/)?{_TOKEN}"), "maven": re.compile(rf"{_TOKEN}:{_TOKEN}"), "golang": re.compile(rf"{_TOKEN}(/[A-Za-z0-9._~+-]+)*")}
_NAME = re.compile(_TOKEN)
_SAFE = re.compile(r"[A-Za-z0-9.*^~<>=!_,+ |-]{1,256}")
_EXACT = re.compile(r"(?=.{1,128}\Z)[0-9][A-Za-z0-9_]*(?:[._+-]+[A-Za-z0-9_]+)*")
_SEMVER = re.compile(r"(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){2}(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][A-Za-z0-9-]*)(\.(0|[1-9][0-9]*|[0-9]*[A-Za-z-][A-Za-z0-9-]*))*)?(\+[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*)?")


def valid_name(name: str, ecosystem: str) -> bool:
    return 0 < len(name) <= 160 and ".." not in name and bool(_NAMES.get(ecosystem, _NAME).fullmatch(name)) and not any(p in (".", "") for p in re.split("[/:]", name))


def exact(version: str | None) -> bool:
    """One version, not a range."""
    if not version or ".." in version or not _EXACT.fullmatch(version):
        return False
    return not any(p.lower() == "x" for p in re.split("[-+]", version)[0].split("."))


def resolved(ecosystem: str, version: str | None) -> bool:
    """An exact version in the ecosystem's own grammar."""
    if not exact(version):
        return False
    if ecosystem in ("npm", "cargo"):
        return bool(_SEMVER.fullmatch(version))
    if ecosystem in ("maven", "gem"):
        return "+" not in version and (ecosystem == "maven" or not re.search("[-_]", version))
    return True


#: Where a version text points to, by how it begins; the first that fits.
_PLACES = (
    ("workspace_inherited", re.compile(r"(workspace|catalog):", re.I)), ("path", re.compile(r"(file|link|path):|[./]", re.I)), ("git", re.compile(r"git[+@]|git://|(github|gitlab|bitbucket):", re.I)),
    ("archive", re.compile(r"[a-z+]+://", re.I)), ("unknown", re.compile(r"(patch|npm):", re.I)), ("git", re.compile(r"[A-Za-z0-9-]+/[A-Za-z0-9._#-]+\Z")),
)


def place(text: str | None) -> str | None:
    """workspace_inherited, path, git, archive or unknown; None for a plain version."""
    return next((name for name, form in _PLACES if form.match(text)), None) if text else None


def _coded(text: str) -> str:
    return "".join(c if re.match("[A-Za-z0-9._~-]", c) else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def package_url(ecosystem: str, name: str, version: str | None = None) -> str:
    """pkg:type/name@version; the version only where it is exact, nothing for other ecosystems."""
    if ecosystem not in ECOSYSTEMS:
        return ""
    path = "/".join(map(_coded, re.split("[:/]" if ecosystem == "maven" else "/", name)))
    return f"pkg:{ecosystem}/{path}" + (f"@{_coded(version)}" if exact(version) else "")


def read_package_url(url: str) -> tuple[str, str, str | None] | None:
    """(ecosystem, name, version) of a package URL in plain form, else None."""
    m = re.fullmatch(r"pkg:([a-z]+)/([^@?#]+)(?:@([^?#]+))?(?:\?[^#]*)?(?:#.*)?", url)
    if not m or m[1] not in ECOSYSTEMS or re.search("%(?![0-9A-Fa-f]{2})", url):
        return None
    parts = [unquote(p) for p in m[2].split("/")]
    shape = {"maven": len(parts) == 2, "npm": len(parts) == 1 or len(parts) == 2 and parts[0].startswith("@"), "golang": True}.get(m[1], len(parts) == 1)
    name = (":" if m[1] == "maven" else "/").join(parts)
    return (m[1], name, unquote(m[3]) if m[3] else None) if shape and valid_name(name, m[1]) else None


def only_line(text: str, form: str) -> int:
    """The line of the only match, else 0."""
    found = [i for i, line in enumerate(text.split("\n"), 1) if re.search(form, line)]
    return found[0] if len(found) == 1 else 0


_AFTER_KEY = re.compile(r"""["']?[^\S\n]*[:=]""")


def _keyed(text: str, key: str) -> int:
    """The only line in which a colon or an equals sign follows the key, else 0. Keys differ from file to file: a pattern of each would have to be compiled."""
    found, at = 0, -1 if "\n" in key else text.find(key)
    while at >= 0:
        on = at + 1
        if _AFTER_KEY.match(text, at + len(key)):
            if found:
                return 0
            found = text.count("\n", 0, at) + 1
            on = text.find("\n", at) + 1
            if not on:
                break
        at = text.find(key, on)
    return found


def npm_manifest(text: str) -> Iterator[Declared]:
    whole = json.loads(text)
    for section, kind in (("dependencies", "manifest"), ("devDependencies", "manifest_dev"), ("peerDependencies", "manifest_peer"), ("optionalDependencies", "manifest_optional")):
        for name, spec in whole.get(section, {}).items():
            at = _keyed(text, name)
            if spec.startswith("npm:"):  # another name for a package
                name, _, spec = spec[4:].rpartition("@")
            yield Declared(name, spec, kind, spec if place(spec) else None, at)


def npm_lock(text: str) -> Iterator[Declared]:
    whole = json.loads(text)
    kind = "lock" if whole.get("lockfileVersion") in (1, 2, 3) else "lock_unverified"

    def one(name: str, entry: dict, at: int) -> Declared:
        home = entry.get("resolved")
        other = "workspace:" if entry.get("link") else home if home and not home.startswith("https://registry.npmjs.org/") else entry.get("version")
        return Declared(name, entry.get("version"), kind, other if place(other) else None, at)

    if whole.get("lockfileVersion") != 1 and "packages" in whole:
        for path, entry in whole["packages"].items():
            if path:
                yield one(entry.get("name") or path.rpartition("node_modules/")[2], entry, _keyed(text, path))
        return
    waiting = [whole.get("dependencies", {})]
    for level in waiting:
        for name, entry in level.items():
            yield one(name, entry, _keyed(text, name))
            waiting.append(entry.get("dependencies", {}))


_CARGO = {"dependencies": "manifest", "dev-dependencies": "manifest_dev", "build-dependencies": "manifest_build"}


def cargo_manifest(text: str) -> Iterator[Declared]:
    whole = tomllib.loads(text)
    for table in (whole, whole.get("workspace", {}), *whole.get("target", {}).values()):
        for section, kind in _CARGO.items():
            for name, spec in table.get(section, {}).items():
                spec = {"version": spec} if isinstance(spec, str) else spec
                source = "workspace:" if spec.get("workspace") else f"path:{spec['path']}" if "path" in spec else f"git+{spec['git']}" if "git" in spec else None
                yield Declared(spec.get("package", name), spec.get("version"), "manifest_optional" if spec.get("optional") else kind, source, _keyed(text, name))


def _toml_packages(text: str, home: Callable[[dict], str | None]) -> Iterator[Declared]:
    for p in tomllib.loads(text).get("package", []):
        yield Declared(p["name"], p.get("version"), "lock", home(p), only_line(text, rf'^name = "{re.escape(p["name"])}"'))


def cargo_lock(text: str) -> Iterator[Declared]:
    return _toml_packages(text, lambda p: None if str(p.get("source", "")).startswith("registry+") else p.get("source", "path:."))


def poetry_lock(text: str) -> Iterator[Declared]:
    forms = {"git": "git+", "directory": "path:", "file": "path:", "url": "https://", "legacy": ""}
    return _toml_packages(text, lambda p: forms.get(p["source"].get("type"), "patch:") or None if "source" in p else None)


def pipfile_lock(text: str) -> Iterator[Declared]:
    whole = json.loads(text)
    for section, kind in (("default", "lock"), ("develop", "lock")):
        for name, entry in whole.get(section, {}).items():
            source = next((f"{form}x" for key, form in (("git", "git+"), ("path", "path:"), ("file", "path:")) if key in entry), None)
            yield Declared(name, (entry.get("version") or "").removeprefix("==") or None, kind, source, _keyed(text, name))


def pnpm_lock(text: str) -> Iterator[Declared]:
    import yaml

    if re.search(r"(^|[\s,\[{:-])[&*!][A-Za-z]", re.sub(r"""'[^'\n]*'|"[^"\n]*\"""", "", text)):
        raise ValueError("aliases and tags are not read")
    # libyaml where it is there; it takes some tabs that the plain loader refuses, so texts with tabs go to that one
    loader = yaml.SafeLoader if "\t" in text else getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for whole in yaml.load_all(text, loader):
        for importer in (whole.get("importers") or {".": whole}).values():
            for section, kind in (("dependencies", "manifest"), ("devDependencies", "manifest_dev"), ("optionalDependencies", "manifest_optional")):
                for name, entry in (importer.get(section) or {}).items():
                    spec = entry.get("specifier") if isinstance(entry, dict) else (importer.get("specifiers") or {}).get(name)
                    yield Declared(name, spec, kind, spec if place(spec) else None, 0)
        for key in whole.get("packages") or {}:
            bare = re.sub(r"\(.*", "", str(key)).removeprefix("/")
            name, _, version = bare.rpartition("@") if "@" in bare[1:] else bare.rpartition("/")
            yield Declared(name, re.sub("_.*", "", version), "lock", version if place(version) else None, _keyed(text, str(key)))


def bill(text: str) -> Iterator[tuple[str, Declared]]:
    """Components of a CycloneDX or packages of an SPDX document: (ecosystem, declared)."""
    whole = json.loads(text)
    waiting = list(whole.get("components", []))
    for c in waiting:
        waiting += c.get("components", [])
        yield from _billed(text, c.get("name"), c.get("version"), c.get("purl"))
    for p in whole.get("packages", []):
        url = next((r.get("referenceLocator") for r in p.get("externalRefs", []) if r.get("referenceType") == "purl"), None)
        yield from _billed(text, p.get("name"), p.get("versionInfo"), url)


def _billed(text: str, name: str, version: str | None, url: str | None) -> Iterator[tuple[str, Declared]]:
    known = read_package_url(url) if url else None
    at = only_line(text, rf'"name"\s*:\s*"{re.escape(str(name))}"')
    if known and (known[2] is None or version is None or known[2] == version):
        yield known[0], Declared(known[1], version or known[2], "sbom", None, at)
    else:
        yield "generic", Declared(str(name), version, "sbom_unverified", None, at)


def go_mod(text: str) -> Iterator[Declared]:
    inside = None
    for at, line in enumerate(text.split("\n"), 1):
        code, _, note = line.partition("//")
        words = code.split()
        if words[-1:] == ["("]:
            inside = words[0]
        elif words == [")"]:
            inside = None
        elif words:
            directive, rest = (inside, words) if inside else (words[0], words[1:])
            if directive == "require" and len(rest) == 2:
                yield Declared(rest[0], rest[1].removeprefix("v").removesuffix("+incompatible"), "manifest_indirect" if note.strip().startswith("indirect") else "manifest", None, at)


def requirements(text: str) -> Iterator[Declared]:
    joined, begun = "", 0
    for at, line in enumerate([*text.split("\n"), ""], 1):
        begun = begun or at
        if line.endswith("\\"):
            joined += line[:-1] + " "
            continue
        whole, first, joined, begun = (joined + line).strip(), begun, "", 0
        whole = re.sub(r"(^|\s)#.*|\s--hash[= ]\S+", "", whole).strip()
        editable = re.match(r"(?:-e|--editable)[ =]\s*(\S+)", whole)
        if editable:
            named = re.search(r"#egg=([A-Za-z0-9._-]+)", editable[1])
            if named:
                yield Declared(named[1], None, "manifest", editable[1] if place(editable[1]) else "path:.", first)
            continue
        m = re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:@\s*(\S+)|([^;@]*))", whole)
        if m and not whole.startswith("-"):
            version = (m[3] or "").strip() or None
            yield Declared(m[1], version.removeprefix("==").strip() if version and "," not in version and version.startswith("==") and "*" not in version else version, "manifest", m[2], first)


_GEM = re.compile(r"""^\s*(?:gem|\w+\.add_(?:runtime_|development_)?dependency)[\s(]+["']([A-Za-z0-9._-]+)["']((?:\s*,\s*["'][^"']*["'])*)(.*)""")


def gemfile(text: str) -> Iterator[Declared]:
    groups: list[bool] = []
    for at, line in enumerate(text.split("\n"), 1):
        code = re.sub(r"(^|\s)#.*", "", line)
        if re.search(r"\bdo\s*(\|\w+\|)?\s*$", code):
            groups.append(bool(re.search(r":(development|test)", code)))
        elif code.strip() == "end" and groups:
            groups.pop()
        elif m := _GEM.match(code):
            version = ",".join(re.findall(r"""["']([^"']*)["']""", m[2])) or None
            source = next((f"{form}x" for word, form in (("git", "git+"), ("github", "git+"), ("path", "path:")) if re.search(rf":?{word}(:|\s*=>)", m[3])), None)
            dev = any(groups) or "development_dependency" in code or bool(re.search(r"group:?\s*(=>)?\s*\[?:(development|test)", m[3]))
            yield Declared(m[1], version, "manifest_dev" if dev else "manifest", source, at)


def gemfile_lock(text: str) -> Iterator[Declared]:
    section = ""
    for at, line in enumerate(text.split("\n"), 1):
        if re.match("[A-Z]", line):
            section = line.strip()
        elif (m := re.match(r"    ([A-Za-z0-9._-]+) \(([0-9][A-Za-z0-9.]*)(?:-[a-z0-9_-]+)?\)$", line)) and section in ("GEM", "GIT", "PATH"):
            yield Declared(m[1], m[2], "lock", {"GIT": "git+x", "PATH": "path:."}.get(section), at)


def _tree(text: str) -> ElementTree.Element:
    if re.search("<!(DOCTYPE|ENTITY)", text):
        raise ValueError("document types are not read")
    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def pom_properties(text: str) -> dict[str, str]:
    """The properties that a project file sets, its own and its parent's coordinates among them."""
    root = _tree(text)
    own = {e.tag: (e.text or "").strip() for e in root.find("properties") or ()}
    for tag in ("groupId", "version", "artifactId"):
        value = root.findtext(tag) or (root.findtext(f"parent/{tag}") if tag != "artifactId" else None)
        if value:
            own[f"project.{tag}"] = value.strip()
        if parent := root.findtext(f"parent/{tag}"):
            own[f"project.parent.{tag}"] = parent.strip()
    return own


def pom(text: str, inherited: dict[str, str] | None = None) -> Iterator[Declared]:
    root, known = _tree(text), {**(inherited or {}), **pom_properties(text)}

    def filled(value: str | None) -> str | None:
        for _ in range(8):
            if not value or "${" not in value or len(value) > 4096:
                break
            value = re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m[1], m[0]), value)
        return value.strip() if value else None

    managed = {}
    for d in root.findall("./dependencyManagement/dependencies/dependency"):
        managed[filled(d.findtext("groupId")), filled(d.findtext("artifactId"))] = filled(d.findtext("version"))
    lists = [(x, "manifest") for x in root.findall("./dependencies/dependency")] + [(x, "manifest_optional") for x in root.findall("./profiles/profile/dependencies/dependency")]
    for d, kind in lists:
        key = filled(d.findtext("groupId")), filled(d.findtext("artifactId"))
        version = filled(d.findtext("version")) or managed.get(key)
        kind = "manifest_dev" if filled(d.findtext("scope")) == "test" else "manifest_optional" if filled(d.findtext("optional")) == "true" else kind
        yield Declared(f"{key[0]}:{key[1]}", None if version and "${" in version else version, kind, None, only_line(text, rf"<artifactId>\s*{re.escape(d.findtext('artifactId') or '')}\s*</artifactId>"))


_GRADLE = re.compile(r"""^\s*(api|implementation|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly)[\s(]+(?:platform\()?(?:["']([^"':$]+):([^"':$]+)(?::([^"'$:@]+))?["']|group\s*[:=]\s*["']([^"']+)["']\s*,\s*name\s*[:=]\s*["']([^"']+)["'](?:\s*,\s*version\s*[:=]\s*["']([^"']+)["'])?)""")


def gradle(text: str) -> Iterator[Declared]:
    for at, line in enumerate(text.split("\n"), 1):
        if m := _GRADLE.match(line):
            yield Declared(f"{m[2] or m[5]}:{m[3] or m[6]}", m[4] or m[7], "manifest_dev" if m[1].startswith("test") else "manifest", None, at)


def gradle_lock(text: str) -> Iterator[Declared]:
    for at, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"([^#:=\s]+:[^:=\s]+):([^:=\s]+)=", line):
            yield Declared(m[1], m[2], "lock", None, at)


#: Format and ecosystem of each manifest's name.
FORMATS: dict[str, tuple[str, Callable[[str], Iterator[Declared]]]] = {
    "package.json": ("npm", npm_manifest), "package-lock.json": ("npm", npm_lock), "pnpm-lock.yaml": ("npm", pnpm_lock), "Cargo.toml": ("cargo", cargo_manifest), "Cargo.lock": ("cargo", cargo_lock),
    "Pipfile.lock": ("pypi", pipfile_lock), "poetry.lock": ("pypi", poetry_lock), "requirements.txt": ("pypi", requirements), "go.mod": ("golang", go_mod), "Gemfile": ("gem", gemfile), "gems.rb": ("gem", gemfile),
    "Gemfile.lock": ("gem", gemfile_lock), "gems.locked": ("gem", gemfile_lock), "pom.xml": ("maven", pom), "build.gradle": ("maven", gradle), "build.gradle.kts": ("maven", gradle), "gradle.lockfile": ("maven", gradle_lock),
}


class Item(NamedTuple):
    name: str
    version: str
    ecosystem: str
    purl: str
    line: int
    source_type: str
    declared: str | None
    resolved: str | None
    origin: str


def items(path: str, text: str, inherited: dict[str, str] | None = None) -> tuple[list[Item], str]:
    """The items of a manifest, and how it went: complete, partial (something could not be read) or truncated."""
    name = path.rpartition("/")[2]
    ecosystem, read = FORMATS.get(name, ("gem", gemfile) if name.endswith(".gemspec") else ("", bill))
    out, bad = [], 0
    try:
        found = [(ecosystem, d) for d in (read(text, inherited) if read is pom else read(text))] if ecosystem else list(bill(text))
    except Exception:  # whatever a parser says of a text that is not its format
        return [], "partial"
    for eco, d in found:
        if len(out) == MOST_ITEMS:
            return out, "truncated"
        if not isinstance(d.name, str) or not valid_name(d.name, eco):
            bad += 1
            continue
        locked = d.kind.startswith("lock") or d.kind.startswith("sbom")
        elsewhere = place(d.source)
        sure = d.kind == "lock" and not elsewhere and resolved(eco, d.version)
        plain = d.version if d.version and _SAFE.fullmatch(d.version) else None
        origin = elsewhere or ("lock_resolved" if sure else "lock_unverified" if d.kind.startswith("lock") else d.kind)
        if d.version and not plain and not elsewhere:
            origin = "unknown"
        kind = "sbom" if d.kind.startswith("sbom") else "lockfile" if locked else "manifest"
        out.append(Item(d.name, plain or "unknown", eco, package_url(eco, d.name, d.version if sure else None), d.line, kind, None if locked else plain, d.version if sure else None, origin))
    return out, "partial" if bad else "complete"


SCHEMA = "path string, status string, name string, version string, ecosystem string, purl string, line int, source_type string, declared string, resolved string, origin string"
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in SCHEMA.split(", ")])


def dependencies(files: DataFrame) -> DataFrame:
    """One row for each item of each manifest or bill of materials among files (path, text[, inherited]); a file without items gives none."""
    from cipherlake.sources import files as X

    chosen = files.where(F.col("text").isNotNull() & (X.is_manifest(F.col("path")) | X.is_sbom(F.col("path"))))
    chosen = chosen.select("path", "text", F.to_json("inherited").alias("inherited") if "inherited" in files.columns else F.lit(None).cast("string").alias("inherited"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found, status = items(r["path"], r["text"], json.loads(r["inherited"]) if r["inherited"] else None)
                rows += [(r["path"], status, *i) for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return chosen.mapInArrow(run, SCHEMA)


def dependency_bill(found: DataFrame) -> DataFrame:
    """Each named dependency of each file once: the bill of materials."""
    version = F.coalesce("version", F.lit("unknown"))
    return found.where("name <> ''").select("name", version.alias("version"), "ecosystem", F.col("path").alias("source_file"), F.coalesce("source_type", F.lit("manifest")).alias("source_type"), "purl").groupBy("ecosystem", "name", "version", "source_file").agg(F.min("source_type").alias("source_type"), F.min("purl").alias("purl"))


def detect(found: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_id, path, line, match): every item as inventory, and again for each (id, pattern) that fits its name, version, ecosystem and package URL."""
    target = F.concat_ws(" ", "name", "version", "ecosystem", "purl")
    hits = F.array(F.lit("__DEPENDENCY_INVENTORY__"), *(F.when(target.rlike(pattern), F.lit(rule)) for rule, pattern in rules))
    return found.select(F.explode(F.array_compact(hits)).alias("rule_id"), "path", "line", F.concat_ws(" ", "ecosystem", "name", "version").alias("match"))


def inherited_properties(files: DataFrame) -> DataFrame:
    """(path, inherited): for each project file what its parents set, nearest first. Parents are looked up by relative path, at most 16 levels up.

    files has path, text. Each level is one join, a written table, until one has no rows; a cycle ends at the level bound and sets nothing new."""
    read = "path string, parent string, properties map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    root, own = _tree(r["text"]), pom_properties(r["text"])
                except Exception:
                    continue
                up = root.findtext("parent/relativePath")
                up = (up.strip() if up else "../pom.xml") if root.find("parent") is not None else None
                rows.append((r["path"], _beside(r["path"], up) if up else None, list({k: v for k, v in own.items() if not k.startswith("project.")}.items())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.map_(pa.string(), pa.string()))], names=["path", "parent", "properties"])

    # read once: (path, parent) is joined with itself level by level, and properties are fetched at the end
    poms = written(files.where(basename(F.col("path")) == "pom.xml").select("path", "text").mapInArrow(run, read), "poms")
    above = poms.where("parent is not null").select(F.col("path").alias("at"), F.col("parent").alias("next"))
    chain = level = written(poms.where("parent is not null").select("path", F.col("parent").alias("at"), F.lit(1).alias("level")), "parents")
    for k in range(2, MOST_LEVELS + 1):
        if level.isEmpty():
            break
        level = written(level.join(above, "at").select("path", F.col("next").alias("at"), F.lit(k).alias("level")), "parents")
        chain = chain.union(level)  # a union of written tables: no work is repeated
    set_ = chain.join(poms.select(F.col("path").alias("at"), "properties"), "at").select("path", "level", F.explode("properties").alias("key", "value"))
    nearest = set_.groupBy("path", "key").agg(F.min_by("value", "level").alias("value"))
    return nearest.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("inherited"))


def _beside(path: str, relative: str) -> str:
    parts = path.split("/")[:-1]
    for p in (relative if relative.endswith(".xml") else relative.rstrip("/") + "/pom.xml").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)
