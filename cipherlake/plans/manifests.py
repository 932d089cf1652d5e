"""Queries of the dependency parsers. Each document carries a manifest with its id in names and versions; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.plans.queries import ORACLE, QUERIES, _quoted, query, table
from cipherlake.sources import manifests as M

Expected = tuple[str, str, str, str, int, str, str | None, str | None, str]
COLUMNS = "name version ecosystem purl line source_type declared resolved origin".split()


def manifest(spark, sf_dir, name: str, text: str):
    """A file of that name for each document; {id} in its text is the document's id."""
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("app/"), doc, F.lit(f"/{name}")).alias("path"), F.replace(F.lit(text), F.lit("{id}"), doc).alias("text"))


def _sql_value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"replace({_quoted(x)}, '{{id}}', CAST(doc_id AS VARCHAR))"


def _sql_rows(name: str, rows: list[Expected]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'app/' || CAST(doc_id AS VARCHAR) || '/{name}' AS path, " + ", ".join(f"CAST({_sql_value(x)} AS {'INT' if c == 'line' else 'VARCHAR'}) AS {c}" for c, x in zip(COLUMNS, r)) + " FROM documents" for r in rows
    )


def add(query_name: str, file_name: str, text: str, rows: list[Expected]) -> None:
    def run(spark, sf_dir):
        return M.dependencies(manifest(spark, sf_dir, file_name, text)).select("path", *COLUMNS)

    QUERIES[query_name], ORACLE[query_name] = run, _sql_rows(file_name, rows)


add(
    "dep_npm_manifest", "package.json",
    '{\n "dependencies": {\n  "left{id}": "^1.{id}.0",\n  "@scope/kit": "npm:real-kit@2.0.0"\n },\n "devDependencies": {\n  "jest": "29.{id}.1",\n  "tool": "github:someone/tool"\n }\n}',
    [("left{id}", "^1.{id}.0", "npm", "pkg:npm/left{id}", 3, "manifest", "^1.{id}.0", None, "manifest"), ("real-kit", "2.0.0", "npm", "pkg:npm/real-kit", 4, "manifest", "2.0.0", None, "manifest"),
     ("jest", "29.{id}.1", "npm", "pkg:npm/jest", 7, "manifest", "29.{id}.1", None, "manifest_dev"), ("tool", "unknown", "npm", "pkg:npm/tool", 8, "manifest", None, None, "git")],
)
add(
    "dep_npm_lock", "package-lock.json",
    '{"lockfileVersion": 3, "packages": {"": {"name": "app"},\n"node_modules/a{id}": {"version": "1.2.{id}", "resolved": "https://registry.npmjs.org/a/-/a.tgz"},\n"node_modules/x/node_modules/@s/b": {"version": "2.0.0-rc.1"},\n"node_modules/c": {"version": "1.0.0", "resolved": "https://host.example/c.tgz"}}}',
    [("a{id}", "1.2.{id}", "npm", "pkg:npm/a{id}@1.2.{id}", 2, "lockfile", None, "1.2.{id}", "lock_resolved"), ("@s/b", "2.0.0-rc.1", "npm", "pkg:npm/%40s/b@2.0.0-rc.1", 3, "lockfile", None, "2.0.0-rc.1", "lock_resolved"), ("c", "1.0.0", "npm", "pkg:npm/c", 4, "lockfile", None, None, "archive")],
)
add(
    "dep_npm_lock_nested", "package-lock.json",
    '{"lockfileVersion": 1, "dependencies": {\n"a": {"version": "1.0.{id}", "dependencies": {\n"b": {"version": "2.0.{id}", "dependencies": {\n"c": {"version": "03.0.0"}}}}}}}',
    [("a", "1.0.{id}", "npm", "pkg:npm/a@1.0.{id}", 2, "lockfile", None, "1.0.{id}", "lock_resolved"), ("b", "2.0.{id}", "npm", "pkg:npm/b@2.0.{id}", 3, "lockfile", None, "2.0.{id}", "lock_resolved"), ("c", "03.0.0", "npm", "pkg:npm/c", 4, "lockfile", None, None, "lock_unverified")],
)
add(
    "dep_cargo_manifest", "Cargo.toml",
    '[dependencies]\nserde{id} = "1.{id}"\nlocal = { path = "../local" }\nrenamed = { package = "real", version = "0.{id}.1", optional = true }\n[dev-dependencies]\nproptest = "1"\n[target."cfg(unix)".dependencies]\nnix = "0.27"\n[workspace.dependencies]\nshared = { git = "https://host.example/shared" }\n',
    [("serde{id}", "1.{id}", "cargo", "pkg:cargo/serde{id}", 2, "manifest", "1.{id}", None, "manifest"), ("local", "unknown", "cargo", "pkg:cargo/local", 3, "manifest", None, None, "path"), ("real", "0.{id}.1", "cargo", "pkg:cargo/real", 4, "manifest", "0.{id}.1", None, "manifest_optional"),
     ("proptest", "1", "cargo", "pkg:cargo/proptest", 6, "manifest", "1", None, "manifest_dev"), ("nix", "0.27", "cargo", "pkg:cargo/nix", 8, "manifest", "0.27", None, "manifest"), ("shared", "unknown", "cargo", "pkg:cargo/shared", 10, "manifest", None, None, "git")],
)
add(
    "dep_cargo_lock", "Cargo.lock",
    'version = 3\n[[package]]\nname = "ring{id}"\nversion = "0.17.{id}"\nsource = "registry+https://github.com/rust-lang/crates.io-index"\n[[package]]\nname = "own"\nversion = "0.1.0"\n',
    [("ring{id}", "0.17.{id}", "cargo", "pkg:cargo/ring{id}@0.17.{id}", 3, "lockfile", None, "0.17.{id}", "lock_resolved"), ("own", "0.1.0", "cargo", "pkg:cargo/own", 7, "lockfile", None, None, "path")],
)
add(
    "dep_pipfile_lock", "Pipfile.lock",
    '{"_meta": {"pipfile-spec": 6}, "default": {\n"cryptography": {"version": "==41.0.{id}"}},\n"develop": {\n"mine": {"git": "https://host.example/mine.git"}}}',
    [("cryptography", "41.0.{id}", "pypi", "pkg:pypi/cryptography@41.0.{id}", 2, "lockfile", None, "41.0.{id}", "lock_resolved"), ("mine", "unknown", "pypi", "pkg:pypi/mine", 4, "lockfile", None, None, "git")],
)
add(
    "dep_poetry_lock", "poetry.lock",
    '[[package]]\nname = "rsa{id}"\nversion = "4.{id}"\n\n[[package]]\nname = "here"\nversion = "0.1"\n[package.source]\ntype = "directory"\nurl = "../here"\n',
    [("rsa{id}", "4.{id}", "pypi", "pkg:pypi/rsa{id}@4.{id}", 2, "lockfile", None, "4.{id}", "lock_resolved"), ("here", "0.1", "pypi", "pkg:pypi/here", 6, "lockfile", None, None, "path")],
)
add(
    "dep_pnpm_lock", "pnpm-lock.yaml",
    "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      jose:\n        specifier: ^5.{id}.0\n        version: 5.{id}.1\npackages:\n  jose@5.{id}.1:\n    resolution: {integrity: x}\n  '@noble/curves@1.4.0(peer@1.0.0)':\n    resolution: {integrity: y}\n",
    [("jose", "^5.{id}.0", "npm", "pkg:npm/jose", 0, "manifest", "^5.{id}.0", None, "manifest"), ("jose", "5.{id}.1", "npm", "pkg:npm/jose@5.{id}.1", 9, "lockfile", None, "5.{id}.1", "lock_resolved"), ("@noble/curves", "1.4.0", "npm", "pkg:npm/%40noble/curves@1.4.0", 11, "lockfile", None, "1.4.0", "lock_resolved")],
)
add(
    "dep_sbom", "sbom.json",
    '{"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [\n{"name": "bcprov", "version": "1.{id}", "purl": "pkg:maven/org.bouncycastle/bcprov@1.{id}", "components": [\n{"name": "inner{id}", "version": "2"}]},\n{"name": "odd", "version": "1", "purl": "pkg:npm/odd@2"}],\n"packages": [{"name": "spdx-one", "versionInfo": "3.0", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:pypi/spdx-one@3.0"}]}]}',
    [("org.bouncycastle:bcprov", "1.{id}", "maven", "pkg:maven/org.bouncycastle/bcprov", 2, "sbom", None, None, "sbom"), ("inner{id}", "2", "generic", "pkg:generic/inner{id}", 3, "sbom", None, None, "sbom_unverified"),
     ("odd", "1", "generic", "pkg:generic/odd", 4, "sbom", None, None, "sbom_unverified"), ("spdx-one", "3.0", "pypi", "pkg:pypi/spdx-one", 5, "sbom", None, None, "sbom")],
)
add(
    "dep_go_mod", "go.mod",
    "module example.org/app{id}\n\ngo 1.21\n\nrequire golang.org/x/crypto v0.{id}.0\nrequire (\n\tgithub.com/some/one v1.2.{id} // indirect\n\tgithub.com/old/two v3.0.0+incompatible\n)\nreplace (\n\tgithub.com/a/b v1.0.0 => ../b\n)\n",
    [("golang.org/x/crypto", "0.{id}.0", "golang", "pkg:golang/golang.org/x/crypto", 5, "manifest", "0.{id}.0", None, "manifest"), ("github.com/some/one", "1.2.{id}", "golang", "pkg:golang/github.com/some/one", 7, "manifest", "1.2.{id}", None, "manifest_indirect"),
     ("github.com/old/two", "3.0.0", "golang", "pkg:golang/github.com/old/two", 8, "manifest", "3.0.0", None, "manifest")],
)
add(
    "dep_requirements", "requirements.txt",
    "# comment\n-r base.txt\nPyJWT[crypto]==2.{id}.0 ; python_version > '3.8'\nrequests >=2,<3 \\\n  --hash=sha256:aa\nmine @ git+https://host.example/mine.git\n-e ./local#egg=here\nplain\n",
    [("PyJWT", "2.{id}.0", "pypi", "pkg:pypi/PyJWT", 3, "manifest", "2.{id}.0", None, "manifest"), ("requests", ">=2,<3", "pypi", "pkg:pypi/requests", 4, "manifest", ">=2,<3", None, "manifest"), ("mine", "unknown", "pypi", "pkg:pypi/mine", 6, "manifest", None, None, "git"),
     ("here", "unknown", "pypi", "pkg:pypi/here", 7, "manifest", None, None, "path"), ("plain", "unknown", "pypi", "pkg:pypi/plain", 8, "manifest", None, None, "manifest")],
)
add(
    "dep_gemfile", "Gemfile",
    "source 'https://rubygems.org'\ngem 'jwt{id}', '~> 2.{id}'\ngroup :development, :test do\n  gem \"rspec\"\nend\ngem 'mine', git: 'https://host.example/mine.git'\n# gem 'gone'\n",
    [("jwt{id}", "~> 2.{id}", "gem", "pkg:gem/jwt{id}", 2, "manifest", "~> 2.{id}", None, "manifest"), ("rspec", "unknown", "gem", "pkg:gem/rspec", 4, "manifest", None, None, "manifest_dev"), ("mine", "unknown", "gem", "pkg:gem/mine", 6, "manifest", None, None, "git")],
)
add(
    "dep_gemspec", "own.gemspec",
    "Gem::Specification.new do |s|\n  s.add_dependency 'openssl', '>= 3.{id}', '< 4'\n  s.add_development_dependency('rake')\nend\n",
    [("openssl", ">= 3.{id},< 4", "gem", "pkg:gem/openssl", 2, "manifest", ">= 3.{id},< 4", None, "manifest"), ("rake", "unknown", "gem", "pkg:gem/rake", 3, "manifest", None, None, "manifest_dev")],
)
add(
    "dep_gemfile_lock", "Gemfile.lock",
    "GIT\n  remote: https://host.example/g.git\n  specs:\n    fork (1.0)\n\nGEM\n  remote: https://rubygems.org/\n  specs:\n    nokogiri (1.15.{id}-x86_64-linux)\n      racc (~> 1.4)\n    racc (1.7.{id})\n\nPLATFORMS\n  ruby\n",
    [("fork", "1.0", "gem", "pkg:gem/fork", 4, "lockfile", None, None, "git"), ("nokogiri", "1.15.{id}", "gem", "pkg:gem/nokogiri@1.15.{id}", 9, "lockfile", None, "1.15.{id}", "lock_resolved"), ("racc", "1.7.{id}", "gem", "pkg:gem/racc@1.7.{id}", 11, "lockfile", None, "1.7.{id}", "lock_resolved")],
)
_POM = '<project xmlns="http://maven.apache.org/POM/4.0.0">\n<groupId>org.own</groupId><artifactId>app</artifactId><version>{id}.0</version>\n<properties><bc>1.{id}</bc><again>${bc}</again></properties>\n<dependencyManagement><dependencies><dependency><groupId>org.m</groupId><artifactId>managed</artifactId><version>7</version></dependency></dependencies></dependencyManagement>\n<dependencies>\n<dependency><groupId>org.bc</groupId><artifactId>bcprov</artifactId><version>${again}</version></dependency>\n<dependency><groupId>${project.groupId}</groupId><artifactId>part</artifactId><version>${project.version}</version><scope>test</scope></dependency>\n<dependency><groupId>org.x</groupId><artifactId>open</artifactId><version>${nowhere}</version></dependency>\n<dependency><groupId>org.m</groupId>\n<artifactId> managed </artifactId></dependency>\n</dependencies></project>'
add(
    "dep_pom", "pom.xml", _POM,
    [("org.bc:bcprov", "1.{id}", "maven", "pkg:maven/org.bc/bcprov", 6, "manifest", "1.{id}", None, "manifest"), ("org.own:part", "{id}.0", "maven", "pkg:maven/org.own/part", 7, "manifest", "{id}.0", None, "manifest_dev"),
     ("org.x:open", "unknown", "maven", "pkg:maven/org.x/open", 8, "manifest", None, None, "manifest"), ("org.m:managed", "7", "maven", "pkg:maven/org.m/managed", 10, "manifest", "7", None, "manifest")],
)
add(
    "dep_gradle", "build.gradle",
    "dependencies {\n  implementation 'org.bc:bcprov:1.{id}'\n  testImplementation(\"junit:junit:4.13\")\n  api group: 'com.n', name: 'jose', version: '9.{id}'\n  runtimeOnly 'a.b:nover'\n  // implementation 'x:y:1'\n}\n",
    [("org.bc:bcprov", "1.{id}", "maven", "pkg:maven/org.bc/bcprov", 2, "manifest", "1.{id}", None, "manifest"), ("junit:junit", "4.13", "maven", "pkg:maven/junit/junit", 3, "manifest", "4.13", None, "manifest_dev"),
     ("com.n:jose", "9.{id}", "maven", "pkg:maven/com.n/jose", 4, "manifest", "9.{id}", None, "manifest"), ("a.b:nover", "unknown", "maven", "pkg:maven/a.b/nover", 5, "manifest", None, None, "manifest")],
)
add(
    "dep_gradle_lock", "gradle.lockfile",
    "# This is a Gradle generated file\norg.bc:bcprov:1.{id}=compileClasspath,runtimeClasspath\nempty=annotationProcessor\n",
    [("org.bc:bcprov", "1.{id}", "maven", "pkg:maven/org.bc/bcprov@1.{id}", 2, "lockfile", None, "1.{id}", "lock_resolved")],
)


@query(
    """SELECT 'm/' || CAST(doc_id AS VARCHAR) || '/c/d/pom.xml' AS path, 'org.bc:bcprov' AS name, '2.' || CAST(doc_id AS VARCHAR) AS version FROM documents
    UNION ALL SELECT 'm/' || CAST(doc_id AS VARCHAR) || '/c/d/pom.xml', 'org.z:top', '9.' || CAST(doc_id AS VARCHAR) FROM documents"""
)
def dep_maven_parent(spark, sf_dir):
    """Properties of a parent and of its parent, the nearer one first."""
    doc = F.col("doc_id").cast("string")
    head = "<project><parent><groupId>g</groupId><artifactId>a</artifactId><version>1</version></parent>"
    texts = {
        "/pom.xml": "<project><groupId>g</groupId><artifactId>a</artifactId><properties><bc>0</bc><top>9.{id}</top></properties></project>",
        "/c/pom.xml": head + "<properties><bc>2.{id}</bc></properties></project>",
        "/c/d/pom.xml": head + "<dependencies><dependency><groupId>org.bc</groupId><artifactId>bcprov</artifactId><version>${bc}</version></dependency><dependency><groupId>org.z</groupId><artifactId>top</artifactId><version>${top}</version></dependency></dependencies></project>",
    }
    each = F.array(*(F.struct(F.concat(F.lit("m/"), doc, F.lit(p)).alias("path"), F.replace(F.lit(t), F.lit("{id}"), doc).alias("text")) for p, t in texts.items()))
    files = table(spark, sf_dir, "documents").select(F.inline(each))
    return M.dependencies(files.join(M.inherited_properties(files), "path", "left")).select("path", "name", "version")


def _requirements(spark, sf_dir):
    return M.dependencies(manifest(spark, sf_dir, "requirements.txt", "PyJWT==2.{id}.0\npycrypto==2.6.1\npycrypto==2.6.1\nplain\n"))


@query("SELECT ecosystem, name, version, 'app/' || CAST(doc_id AS VARCHAR) || '/requirements.txt' AS source_file, 'manifest' AS source_type, 'pkg:pypi/' || name AS purl FROM (SELECT doc_id, 'pypi' AS ecosystem, 'PyJWT' AS name, '2.' || CAST(doc_id AS VARCHAR) || '.0' AS version FROM documents UNION ALL SELECT doc_id, 'pypi', 'pycrypto', '2.6.1' FROM documents UNION ALL SELECT doc_id, 'pypi', 'plain', 'unknown' FROM documents)")
def agg_sbom(spark, sf_dir):
    return M.dependency_bill(_requirements(spark, sf_dir))


@query("""WITH i AS (SELECT doc_id, unnest([{'n': 'PyJWT', 'v': '2.' || CAST(doc_id AS VARCHAR) || '.0', 'l': 1}, {'n': 'pycrypto', 'v': '2.6.1', 'l': 2}, {'n': 'pycrypto', 'v': '2.6.1', 'l': 3}, {'n': 'plain', 'v': 'unknown', 'l': 4}]) AS e FROM documents)
    SELECT r AS rule_id, 'app/' || CAST(doc_id AS VARCHAR) || '/requirements.txt' AS path, CAST(e.l AS INT) AS line, 'pypi ' || e.n || ' ' || e.v AS match FROM i, (VALUES ('__DEPENDENCY_INVENTORY__', ''), ('DEP_JWT', 'PyJWT'), ('DEP_OLD_CRYPTO', 'pycrypto')) t(r, n) WHERE t.n IN ('', e.n)""")
def det_dependency(spark, sf_dir):
    return M.detect(_requirements(spark, sf_dir), [("DEP_JWT", r"(?i)\bpyjwt\b"), ("DEP_OLD_CRYPTO", r"\bpycrypto\b 2\.")])


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pkg:npm/%40s' || CAST(page_id AS VARCHAR) || '/kit@1.0.' || CAST(page_id AS VARCHAR) WHEN page_id % 4 = 1 THEN 'pkg:maven/org.g/a' || CAST(page_id AS VARCHAR) WHEN page_id % 4 = 2 THEN 'pkg:pypi/p' || CAST(page_id AS VARCHAR) || '@2' ELSE '' END AS purl,
    CASE page_id % 4 WHEN 0 THEN '@s' || CAST(page_id AS VARCHAR) || '/kit' WHEN 1 THEN 'org.g:a' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'p' || CAST(page_id AS VARCHAR) END AS name FROM pages""")
def fn_package_url(spark, sf_dir):
    """Package URLs made, and read back."""
    schema = "page_id long, purl string, name string"

    def run(batches):
        import pandas as pd

        for b in batches:
            made = [M.package_url(("npm", "maven", "pypi", "other")[k % 4], (f"@s{k}/kit", f"org.g:a{k}", f"p{k}", "x")[k % 4], (f"1.0.{k}", "[1,2)", "2", "1")[k % 4]) for k in b["page_id"]]
            yield pd.DataFrame({"page_id": b["page_id"], "purl": made, "name": [(M.read_package_url(u) or (None, None))[1] for u in made]})

    return table(spark, sf_dir, "pages").select("page_id").mapInPandas(run, schema)
