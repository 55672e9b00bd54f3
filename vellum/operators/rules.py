"""Finding rules that need more than a pattern over a line (survey D1-D7, D9-D11, D13, D14, D16, D19-D22, D24-D35, D37-D39, D45-D92, X11).

A file is read once: comments are blanked, calls are cut out with their arguments by
matching brackets, functions come from `syntax`, and each family of rules looks at that.

* calls: a callee, its languages, and what its arguments must be;
* near: anchors that fire unless (or only if) something stands within some lines;
* units: words that a file must have and must not have together;
* flows: parameters (and other inputs) of a function followed through assignments, in
  order, to sinks; an assignment from clean text or through a sanitizer cleans a name;
* contracts, routing documents, endpoints: small readers of their own.

Rows are (path, id, severity, line, detail).  Files of no known language give no rows;
text that is no valid program gives what could be read of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import syntax
from .syntax import blanked, entities, language_of, per_file

FINDINGS = "path string, id string, severity string, line int, detail string"


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


# --- calls --------------------------------------------------------------------------


@dataclass
class Call:
    callee: str
    args: list[str]
    start: int
    whole: str


_CALL = re.compile(r"(?<![\w$])((?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.|:)(?:[A-Za-z_$][\w$]*(?:\(\))?))*)\s*(?=\()")


def _split(args: str) -> list[str]:
    """Arguments between top-level commas; quoted commas do not count."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(args):
        c = args[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(args[start:i].strip())
            start = i + 1
        i += 1
    last = args[start:].strip()
    return [*out, last] if last or out else []


def calls(code: str, bare: str) -> Iterator[Call]:
    """Calls of a file; bare is the code with strings blanked, so brackets in strings do not count."""
    for m in _CALL.finditer(bare):
        open_ = bare.index("(", m.end())
        end = syntax._closing(bare, open_)
        yield Call(re.sub(r"\s+", " ", m[1]), _split(code[open_ + 1 : end - 1]), m.start(), code[m.start() : end])


def literal(arg: str) -> bool:
    """Whether an argument is quoted text alone, with nothing put into it."""
    s = arg.strip().lstrip("@")
    m = re.fullmatch(r"[rbuRBU]{0,2}(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|\"\"\"[\s\S]*\"\"\")", s)
    return bool(m) and not re.search(r"\$\{|#\{", s) or bool(re.fullmatch(r"[\d.]+|true|false|null|None|nil", s))


def joined(arg: str) -> bool:
    """Whether an argument is put together from quoted text and something else."""
    return bool(re.search(r"[\"'`]\s*(?:\+|\.(?!\w+\()|%)|(?:\+|\.)\s*[\"'`]", arg)) and not literal(arg)


def woven(arg: str) -> bool:
    """Whether an argument is a template or formatted text with a value in it."""
    return bool(re.match(r"[fF][\"'].*\{", arg.strip(), re.S)) or bool(re.match(r"`[^`]*\$\{", arg.strip())) or bool(re.search(r"\"[^\"]*#\{", arg)) or bool(re.match(r"\$\"[^\"]*\{", arg.strip()))


_SQL = re.compile(r"(?i)[\"'`]\s*(?:select|insert|update|delete|drop|replace)\b")
_first = lambda c: c.args[0] if c.args else ""
_dynamic = lambda c: bool(c.args) and not literal(c.args[0])
_sql = lambda c: any(_SQL.search(a) and joined(a) for a in c.args)
_url = lambda c: bool(c.args) and (joined(c.args[0]) or woven(c.args[0]))
_any = lambda c: True
_shells = re.compile(r"[\"'](?:/bin/)?(?:sh|bash|zsh|cmd|cmd\.exe|powershell)[\"']")

PY, JS, JAVA, CS, GO, C, RB, PHP, KT, SCALA, SWIFT, SH, LUA, NIX, GD, OBJC, RUST = ("py",), ("js",), ("java",), ("cs",), ("go",), ("cpp",), ("rb",), ("php",), ("kt",), ("scala",), ("swift",), ("sh",), ("lua",), ("nix",), ("gd",), ("m",), ("rs",)

#: Languages, callee, condition, id, severity; tests are left out where the last is set.
CALLS = [
    (PY, r"subprocess\.(?:run|call|Popen|check_output|check_call)", lambda c: any(re.sub(r"\s", "", a) == "shell=True" for a in c.args), "security:subprocess_shell_injection", "Critical", False),
    (PY, r".*\.(?:execute|executemany|raw|query)", lambda c: bool(c.args) and bool(_SQL.search(c.args[0])) and joined(c.args[0]), "security:sqli_concatenation", "Critical", False),
    (PY, r"(?:requests\.(?:get|post|put|delete|head|patch|request)|urllib\.request\.urlopen|urlopen|httpx\.(?:get|post))", lambda c: bool(c.args) and "+" in blanked(c.args[0], "py", True), "security:ssrf_dynamic_url", "Critical", False),
    (PY, r"open", lambda c: bool(c.args) and "+" in blanked(c.args[0], "py", True) and "os.path.join" not in c.args[0], "security:path_traversal_concatenation", "Critical", False),
    (PY, r"exec", _dynamic, "security:code_execution", "Critical", True),
    (PY, r"eval", _dynamic, "security:dynamic_eval", "Critical", True),
    (PY, r"pickle\.loads?", _any, "security:unsafe_deserialization", "Critical", True),
    (PY, r"os\.system", _dynamic, "security:os_command_injection", "Critical", True),
    (PY, r"__import__", _dynamic, "security:dynamic_import", "Critical", True),
    (PY, r"(?:.*\.from_pretrained|pipeline)", lambda c: not any(re.match(r"revision\s*=\s*[\"'][0-9a-f]{40}[\"']", a) for a in c.args), "security:unpinned_ml_model_weights", "High", False),
    (JS, r".*\.(?:query|execute|raw)", _sql, "security:sqli_concatenation", "Critical", False),
    (JS, r"(?:fetch|axios(?:\.\w+)?|request(?:\.\w+)?|got(?:\.\w+)?|https?\.(?:get|request))", _url, "security:ssrf_dynamic_url", "Critical", False),
    (JS, r"(?:fs\.)?(?:promises\.)?(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync|open)", lambda c: bool(c.args) and joined(c.args[0]) and "path.join" not in c.args[0], "security:path_traversal_concatenation", "Critical", False),
    (JAVA, r".*\.(?:executeQuery|executeUpdate|execute|prepareStatement|createQuery|createNativeQuery)", _sql, "security:sqli_concatenation", "Critical", True),
    (JAVA, r".*getRuntime\(\)\.exec", _dynamic, "security:runtime_exec_injection", "Critical", True),
    (JAVA, r"new ProcessBuilder", _dynamic, "security:process_builder_injection", "Critical", True),
    (JAVA, r"new XMLDecoder", _any, "security:unsafe_deserialization", "Critical", True),
    (CS, r"new (?:Sql|MySql|Npgsql|Sqlite)Command", _sql, "security:sqli_concatenation", "Critical", False),
    (CS, r"new BinaryFormatter", _any, "security:unsafe_deserialization", "Critical", False),
    (GO, r"exec\.Command(?:Context)?", lambda c: any(_shells.fullmatch(a) for a in c.args[:2]), "security:command_injection_shell_exec", "Critical", True),
    (GO, r".*\.(?:Query|Exec|QueryRow|QueryContext|ExecContext|QueryRowContext)", _sql, "security:sqli_concatenation", "Critical", True),
    (GO, r"http\.(?:Get|Post|Head)", lambda c: bool(c.args) and (joined(c.args[0]) or "Sprintf" in c.args[0]), "security:ssrf_dynamic_url", "Critical", True),
    (C, r"(?:gets|strcpy|strcat|sprintf|vsprintf)", _any, "security:unsafe_string_function", "Critical", False),
    (C, r"(?:system|popen)", _dynamic, "security:os_command_injection", "Critical", False),
    (C, r"strncat", lambda c: len(c.args) == 3 and re.search(r"sizeof\s*\(?\s*" + re.escape(c.args[0]), c.args[2]) is not None, "security:lcm_unbounded_strncat", "Critical", False),
    (C, r"(?:vsprintf|vprintf)", _any, "security:lcm_unbounded_vprintf", "Critical", False),
    (C, r"(?:malloc|calloc|realloc)", lambda c: bool(c.args) and re.search(r"\w\s*\*\s*(?:sizeof|\w)", c.args[-1]) is not None and not re.search(r"\((?:size_t|SIZE_T)\)", c.whole), "security:lcm_malloc_integer_truncation", "Critical", False),
    (RB, r"Marshal\.(?:load|restore)", _any, "security:unsafe_deserialization", "Critical", True),
    (RB, r"(?:Kernel\.)?(?:eval|system|exec|spawn)", _dynamic, "security:dangerous_execution", "Critical", True),
    (RB, r".*\.where", lambda c: bool(c.args) and "#{" in c.args[0], "security:sqli_concatenation", "Critical", True),
    (PHP, r"eval", _dynamic, "security:eval_injection", "Critical", True),
    (PHP, r"unserialize", _dynamic, "security:unsafe_deserialization", "Critical", False),
    (PHP, r"(?:system|exec|shell_exec|passthru)", _dynamic, "security:command_injection", "Critical", True),
    (PHP, r"(?:mysqli_query|.*->(?:query|real_query))", lambda c: any(_SQL.search(a) and re.search(r"[\"']\s*\.", a) for a in c.args), "security:sqli_concatenation", "Critical", True),
    (KT, r".*getRuntime\(\)\.exec", _dynamic, "security:command_injection_runtime_exec", "Critical", False),
    (KT + SCALA, r"(?:.*\.)?Class\.forName", _dynamic, "security:dynamic_class_loading", "Critical", False),
    (SWIFT, r"dlopen", lambda c: _dynamic(c) and not _first(c).startswith("#"), "security:dynamic_symbol_resolution", "Critical", False),
    (SWIFT + OBJC, r"NSClassFromString", lambda c: _dynamic(c) and not _first(c).startswith("#"), "security:dynamic_class_loading", "Critical", False),
    (LUA, r"(?:loadstring|load)", _dynamic, "security:eval_injection", "Critical", False),
    (LUA, r"os\.execute", _dynamic, "security:command_injection", "Critical", False),
    (GD, r"OS\.execute", _dynamic, "security:command_injection", "Critical", False),
    (GD, r"load", _dynamic, "security:dynamic_class_loading", "Critical", False),
    (RUST, r"(?:.*::)?transmute", _any, "security:unsafe_transmute", "Critical", False),
]
_COMPILED = [(langs, re.compile(callee), test, id_, severity, skip) for langs, callee, test, id_, severity, skip in CALLS]


def _of_calls(lang: str, code: str, bare: str, tests: list[tuple[int, int]]) -> Iterator[tuple]:
    rules = [r for r in _COMPILED if lang in r[0]]
    for c in calls(code, bare) if rules else ():
        for _, callee, test, id_, severity, skip in rules:
            if callee.fullmatch(c.callee) and test(c) and not (skip and any(a <= c.start < b for a, b in tests)):
                end = code.find("\n", c.start)
                if lang == "py" and skip and "# noqa" in code[c.start : end if end >= 0 else len(code)]:
                    continue
                yield id_, severity, c.start, c.callee


# --- patterns that look at their surroundings ---------------------------------------

#: Languages, pattern, what must not stand in the file, id, severity.
PATTERNS = [
    (JAVA, r"\b(?:ObjectInputStream|XMLDecoder|XStream)\b[^;]*;[\s\S]{0,400}?\.readObject\s*\(", None, "security:unsafe_deserialization", "Critical"),
    (JAVA, r"InitialContext\s*\(\s*\)[\s\S]{0,400}?\.(?:lookup|resolve)\s*\(\s*(?![\"')])", None, "security:jndi_injection", "Critical"),
    (JAVA, r"DocumentBuilderFactory\.newInstance\s*\(", r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING", "security:xxe_documentbuilder", "Critical"),
    (CS, r"TypeNameHandling\s*=\s*TypeNameHandling\.(?!None)\w+", None, "security:unsafe_deserialization", "Critical"),
    (GO, r"InsecureSkipVerify\s*:\s*true", r"VerifyPeerCertificate", "security:tls_verification_bypass", "Critical"),
    (SH, r"(?m)^[^#\n]*\beval\s+[\"']?\$\{?\w", None, "security:eval_injection", "Critical"),
    (SH, r"(?m)^[^#\n]*\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b", None, "security:curl_pipe_execution", "Critical"),
    (NIX, r"\bfetchurl\s*(?:\{(?![^}]*(?:sha256|hash))[^}]*\}|\"[^\"]*\")", None, "security:unverified_fetch", "Critical"),
    (NIX, r"builtins\.exec\s*(?!\[\s*(?:\"[^\"$]*\"\s*)*\])\S", None, "security:nix_exec_injection", "Critical"),
    (OBJC, r"valueForKeyPath:\s*(?!@?\")\S", None, "security:kvc_injection", "Critical"),
    (SCALA, r"(?:readObject|fromXML|readResolve|deserialize|parseBytes|fromBytes)\w*\s*\([^)]*\)\s*\.asInstanceOf\b", None, "security:unsafe_deserialization", "Critical"),
    (RUST, r"\bunsafe\s*\{[^}]*\*\s*(?:mut\s+|const\s+)?\w+\b[^}]*\}", None, "security:raw_pointer_deref", "High"),
    (JS, r"\.__proto__|\[[\"']__proto__[\"']\]|\[constructor\]\[prototype\]", None, "security:prototype_pollution", "Critical"),
    (JS, r"\.innerHTML\s*\+?=(?!=)\s*(?![\"'][^\"'+]*[\"']\s*;)", None, "security:dom_xss_innerHTML", "Critical"),
    (JS, r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*(?![\"'])", r"DOMPurify|sanitize", "security:react_xss_dangerous_html", "Critical"),
]


def _of_patterns(lang: str, code: str) -> Iterator[tuple]:
    for langs, pattern, unless, id_, severity in PATTERNS:
        if lang in langs and not (unless and re.search(unless, code)):
            for m in re.finditer(pattern, code):
                yield id_, severity, m.start(), m[0].split("\n")[0][:80]


# --- anchors and what stands near -----------------------------------------------------

# Identity merges, verified mail, ciphers, fixed nonces, classical and hybrid keys, secrets, comparisons.
MERGES = ("linkAccount", "link_account", "mergeAccount", "merge_account", "connectProvider", "connect_provider", "associateIdentity", "associate_identity", "find_or_create_by", "findOrCreateBy", "OAuth.link", "passport.authenticate", "OmniAuth", "omniauth", "provider_link", "account_link", "NextAuth", "linkWithCredential", "linkWithPopup", "linkWithRedirect")
VERIFIED = ("email_verified", "emailVerified", "email_confirmed", "emailConfirmed", "isVerified", "is_verified", "verifiedEmail", "verified_email", "email_verification_token", "confirm_email", "confirmEmail", "verifyEmail", "verify_email", "EmailVerified", "id_token_hint", "email:verified")
CIPHERS = ("AES-GCM", "AES_GCM", "aes-gcm", "aes_gcm", "AesGcm", "ChaCha20", "chacha20", "CHACHA20", "XChaCha20", "xchacha20", "AES-CCM", "aes-ccm", "AesCcm", "createCipheriv", "Cipher.getInstance", "crypto.createCipher", "EVP_EncryptInit", "EVP_aead_aes_128_gcm", "EVP_aead_aes_256_gcm")
FIXED_NONCES = ('iv = b"', 'iv = "', 'iv="', 'nonce = b"', 'nonce = "', 'nonce="', "iv = [", "nonce = [", 'Buffer.from("', 'bytes.fromhex("', "bytes.fromhex('", "\\x00\\x00\\x00", "0x000000")
CLASSICAL = ("RSA.generate", "RSA.new", "rsa.generate_private_key", "rsa.generate_key", "Rsa::generate", 'generateKeyPair("rsa"', "generateKeyPair('rsa'", "RSA_generate_key", "ECDH.generateKeys", "ec.generateKeyPair", "EC_KEY_new", "EC_KEY_generate", "crypto.ECDH", "ecdh.generateKeys", "EllipticCurve.generate", "EcdhKeyAgreement", "EcKeyPairGenerator", 'KeyPairGenerator.getInstance("EC"', 'KeyPairGenerator.getInstance("RSA"', "x25519_dalek::EphemeralSecret", "x25519::StaticSecret")
HYBRID = ("ml_kem", "ML-KEM", "mlkem", "kyber", "Kyber", "KYBER", "ml_dsa", "ML-DSA", "pqcrypto", "liboqs", "oqs", "x-wing", "xwing", "hybrid_kem", "hybrid_key", "fips204", "fips203", "CRYSTALS")
SECRETS = ("createHmac", "hmac.digest", "HMAC(", "hmac(", "computeHmac", "hashlib.pbkdf2", "hashlib.scrypt", "bcrypt.hashpw", "bcrypt.hash", "Argon2", "argon2", "pbkdf2_hmac", "scrypt(", "derive_key", "deriveKey", "jwt.sign", "jwt.encode", "crypto.sign(", "Ed25519.sign(", "ed25519.sign(", "password_hash", "hash_password", "make_password")
COMPARISONS = (" === ", " !== ", " == ", " != ", ".equals(", ".compareTo(", "str_eq(", "strncmp(", "strcmp(", "memcmp(")
CONSTANT_TIME = ("timingSafeEqual", "timing_safe_equal", "compare_digest", "constant_time_compare", "constantTimeCompare", "ct_eq", "ConstantTimeEq", "constant_time_eq", "secure_compare", "secureCompare", "safeEqual", "safe_equal")
_CODE = ("py", "js", "java", "cs", "go", "rb", "php", "rs", "kt", "cpp", "swift")
#: Languages, anchors, lines on either side, what must stand there, what must not, id, severity, whether every anchor counts.
NEAR = [
    (_CODE, MERGES, 30, None, VERIFIED, "security:oauth_account_fusion_pretakeover", "KevCritical", True),
    (_CODE, CIPHERS, 15, FIXED_NONCES, None, "security:nonce_reuse", "Critical", True),
    (_CODE, CLASSICAL, 30, None, HYBRID, "security:pqc_hybrid_downgrade", "High", True),
    (_CODE, SECRETS, 20, COMPARISONS, CONSTANT_TIME, "security:non_constant_time_comparison", "Critical", True),
]


def _of_near(lang: str, text: str) -> Iterator[tuple]:
    for langs, anchors, lines, must, never, id_, severity, _ in NEAR:
        if lang not in langs:
            continue
        for m in re.finditer("|".join(map(re.escape, anchors)), text):
            here = text.split("\n")
            at = _line(text, m.start()) - 1
            window = "\n".join(here[max(0, at - lines) : at + lines + 1])
            if (must is None or any(w in window for w in must)) and not (never and any(w in window for w in never)):
                yield id_, severity, m.start(), m[0]


# --- units ----------------------------------------------------------------------------

# Fixed values, all lower case: assertions, parsers, their hardening, signatures, identifiers.
SAML = ("saml", "samlresponse", "assertion", "urn:oasis:names:tc:saml")
XML_PARSERS = ("xmldom", "xml2js", "documentbuilderfactory.newinstance(", "saxparserfactory.newinstance(", "lxml.etree.fromstring", "xml.etree.elementtree.fromstring", "xml.dom.minidom.parse", "xml.newdecoder(")
HARDENED = ("disallow-doctype-decl", "external-general-entities", "external-parameter-entities", "load-external-dtd", "feature_secure_processing", "resolveentities:false", "resolve_entities=false", "no_network=true")
SIGNATURES = ("verifysignature", "validate(signature", "signaturevalidator", "checksignature", "xmlsec", "validate_signature")
ASSERTION_IDS = ("assertionid", 'getattribute("id"', "getattribute('id'", '.attr("id"', ".attr('id'", "inresponseto", "subjectconfirmationdata")
AUTHORIZE = ("/authorize", "/oauth2/authorize", "authorize?")
SCOPE_MARKS = ("scope=", "scope:", "request_token", "oauth/authorize", "oauth2/authorize", "/authorize")
WIDE_SCOPES = ("admin:org", "admin:enterprise", "scope=*", "scope=%2a")
CHAT_CALLS = ("ChatCompletion.create", "messages.create(", "langchain.llms", "langchain_community.llms", "LLMChain(", "AgentExecutor.from_agent_and_tools", "initialize_agent(")
MODEL_CALLS = ("openai.chat", "openai.ChatCompletion", "chat.completions.create", "client.chat.completions.create", "anthropic.messages.create", "messages.create")
USER_INPUTS = ("req.body", "req.query", "request.json", "request.form", "user_input", "userInput", "prompt_input", "input(")
ISOLATED = ("strict_system_prompt", "system_prompt_isolated", "PromptInjectionDetector", "sanitizePrompt", "sanitize_prompt", "llm_guard", "rebuff")
AGENT_FRAMEWORKS = ("langchain", "autogen", "crewai", "crew ai")
TOOL_MARKS = ("tool(", "tool.from_function", "structuredtool", "dynamictool", "@tool", "agenttool", "tools=[", "tools: [", "tool =", "new tool")
PROCESS_SINKS = ("subprocess.", "os.system", "child_process", "execsync", "spawn(", "exec(")
FILE_SINKS = ("fs.writefile", "writefilesync", "filesystem.write", "path.write_text")
CONTAINED = ("sandbox", "allowlist", "denylist", "seccomp", "capability", "jail", "validate_tool_input", "safe_tool")


def _find(text: str, words) -> int:
    """The first place of any word, or -1."""
    found = [at for at in (text.find(w) for w in words) if at >= 0]
    return min(found, default=-1)


def _of_units(lang: str, text: str) -> Iterator[tuple]:
    low = text.lower()
    if lang in _CODE:
        if _find(low, SAML) >= 0:
            parser, signed, bound = _find(low, XML_PARSERS), _find(low, SIGNATURES), _find(low, ASSERTION_IDS)
            if parser >= 0 and _find(low, HARDENED) < 0:
                yield "security:xxe_saml_parser", "KevCritical", parser, "parser without hardening"
            elif 0 <= signed < bound:
                yield "security:saml_xsw_validation_order", "KevCritical", signed, "signature before identifier"
        at = _find(low, AUTHORIZE)
        if at >= 0 and _find(low, ("response_type=code", "response_type=token", "response_type=id_token")) >= 0:
            nonce = "nonce=" not in low and _find(low, ("openid", "response_type=token", "response_type=id_token")) >= 0
            if "state=" not in low or nonce:
                yield "security:oauth_csrf_missing_state", "KevCritical", at, "nonce" if "state=" in low else "state"
        for m in re.finditer("|".join(map(re.escape, SCOPE_MARKS)), low):
            window = low[max(0, m.start() - 256) : m.start() + 512]
            if _find(window, WIDE_SCOPES) >= 0 or re.search(r"scope[^\n;]{0,80}[\"'=\s,\[](?:repo|\*)[\"'\s,&\]]", window):
                yield "security:oauth_excessive_scope", "KevCritical", m.start(), "wide scope"
                break
        at = _find(text, MODEL_CALLS)
        if at >= 0 and _find(text, USER_INPUTS) >= 0:
            left = 0.95 * (0.18 if _find(text, ISOLATED) >= 0 else 0.74 if re.search(r"[\"']?role[\"']?\s*[:=]\s*[\"']system", text) else 0.96)
            if left > 0.85:
                yield "security:probabilistic_llm_hijack", "KevCritical", at, f"{left:.2f}"
    if lang in ("py", "js"):
        at = _find(text, CHAT_CALLS)
        if at >= 0 and not re.search(r"\b(?:guardrail|sanitize|PromptInjectionDetector)", text):
            yield "security:llm_prompt_injection", "Critical", at, "model call"
        if _find(low, AGENT_FRAMEWORKS) >= 0 and _find(low, ("input(", "request.", "req.body", "req.query", "user_prompt", "userprompt", "prompt")) >= 0 and _find(low, TOOL_MARKS) >= 0 and _find(low, CONTAINED) < 0:
            for sinks, name in ((PROCESS_SINKS, "process"), (FILE_SINKS, "file")):
                if _find(low, sinks) >= 0:
                    yield "security:agentic_privilege_escalation", "KevCritical", _find(low, TOOL_MARKS), name
    if lang in ("py", "js", "rs") and re.search(r"(?i)openai|anthropic|llm", text):
        yield from _agentic_loops(lang, text)
    if lang in ("sh", "py", "js", "rs", "go"):
        for m in re.finditer(r"qemu-(?:system-\w+|kvm)[^\n]*", text):
            if re.search(r"-nographic|-daemonize|-snapshot", m[0]):
                yield "security:hypervisor_evasion_scaffolding", "Critical", m.start(), m[0][:60]


def _agentic_loops(lang: str, text: str) -> Iterator[tuple]:
    """A loop in which what a model answered is run."""
    code = blanked(text, lang)
    for m in re.finditer(r"(?m)^[ \t]*(?:while|for|loop)\b[^\n]*", code):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        body, end = syntax._end_of(blanked(text, lang, True), m.end() if lang == "py" else at, "indent" if lang == "py" else "brace", at)
        inside = code[body:end]
        bound = {b[1] for b in re.finditer(r"(\w+)\s*=\s*[^\n;]*(?:chat|completions?|messages|llm|generate|invoke)[\w.]*\s*\(", inside)}
        bound |= {b[1] for b in re.finditer(r"(\w+)\s*=\s*([^\n;]+)", inside) if any(re.search(rf"\b{re.escape(v)}\b", b[2]) for v in bound)}
        for s in re.finditer(r"\b(?:eval|exec|os\.system|subprocess\.\w+|execSync|spawn|Command::new)\s*\(([^\n]*)", inside):
            if any(re.search(rf"\b{re.escape(v)}\b", s[1]) for v in bound):
                yield "security:bare_metal_agentic_loop", "KevCritical", at, s[0][:60]
                break


# --- scopes -----------------------------------------------------------------------------

# Scopes of providers and what they allow.
SCOPES = {
    "repo": "Write", "repo:status": "Write", "repo:deployment": "Write", "public_repo": "Write", "repo:invite": "Write", "security_events": "Write", "admin:org": "Admin", "admin:public_key": "Admin",
    "admin:repo_hook": "Admin", "admin:org_hook": "Admin", "delete_repo": "Delete", "admin:*": "Admin", "https://www.googleapis.com/auth/admin.*": "Admin", "https://www.googleapis.com/auth/cloud-platform": "Admin",
    "https://www.googleapis.com/auth/iam": "Admin", "https://www.googleapis.com/auth/drive": "Write", "https://www.googleapis.com/auth/gmail.modify": "Write", "https://www.googleapis.com/auth/gmail.compose": "Write",
    "Directory.ReadWrite.All": "Admin", "Application.ReadWrite.All": "Admin", "RoleManagement.ReadWrite.Directory": "Admin", "User.ReadWrite.All": "Write", "Group.ReadWrite.All": "Write", "Files.ReadWrite.All": "Write",
    "Mail.ReadWrite": "Write", "admin": "Admin", "chat:write": "Write", "files:write": "Write", "users:write": "Write", "channels:write": "Write", "groups:write": "Write", "pins:write": "Write", "reactions:write": "Write",
    "bot": "Write", "guilds.join": "Write", "applications.commands.update": "Write", "manage:jira-project": "Admin", "manage:jira-configuration": "Admin", "write:confluence-content": "Write", "delete:confluence-content": "Delete",
    "*": "Unbounded", "__all__": "Unbounded",
}


def scope_tokens(source: Column) -> Column:
    """Distinct scope tokens: words of the quoted strings within 512 characters of the word scope, in order."""
    windows = F.regexp_extract_all(source, F.lit(r"(?s)(scope[^;]{0,506})"), F.lit(1))
    quoted = F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(r"\"([^\"]*)\""), F.lit(1))))
    words = F.flatten(F.transform(quoted, lambda q: F.split(F.trim(q), r"\s+")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[A-Za-z0-9:/_.*-]{1,256}$"))))


def scope_risk(token: Column) -> Column:
    """What a scope allows: its own entry, or that of a family ending in a star; null for harmless ones."""
    table = F.create_map(*[F.lit(x) for p in SCOPES.items() for x in p])
    out = F.try_element_at(table, token)
    for family, risk in SCOPES.items():
        if family.endswith("*") and len(family) > 1:
            out = F.coalesce(out, F.when(token.startswith(family[:-1]), risk))
    return out


def scope_drift(files: DataFrame) -> DataFrame:
    """(path, token, risk) of scopes that allow more than reading."""
    tokens = files.select("path", F.explode(scope_tokens(F.col("content").cast("string"))).alias("token"))
    return tokens.withColumn("risk", scope_risk(F.col("token"))).where("risk IS NOT NULL")


# --- flows ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Flow:
    """Where untrusted values of a language come from and what they must not reach."""

    sink: str  # pattern; group 1 is what reaches it
    id: str
    sources: str = ""  # further inputs, as a pattern
    sigil: str = ""
    whole: bool = False  # inputs are of the file, not of a function
    public: str = ""  # only functions whose definition matches


FLOWS: dict[str, list[Flow]] = {
    "go": [Flow(r"\.(?:Query|Exec|QueryRow|QueryContext|ExecContext)\s*\(([^;\n]*\+[^;\n]*)\)", "security:sqli_concatenation")],
    "rb": [Flow(r"\.where\s*\(?\s*(\"[^\"\n]*#\{[^\"\n]*)", "security:sqli_concatenation")],
    "php": [Flow(r"(?:mysqli_query\s*\(|->\s*(?:query|real_query)\s*\()([^;\n]*\.[^;\n]*)", "security:sqli_concatenation", sources=r"\$_(?:GET|POST|REQUEST|COOKIE)\[[^\]]*\]", sigil="$")],
    "kt": [Flow(r"(?:getRuntime\(\)\s*\.exec|ProcessBuilder)\s*\(([^\n]*)\)", "security:os_command_injection"), Flow(r"\.execute(?:Query|Update)\s*\(([^\n]*(?:\+|\$)[^\n]*)\)", "security:sqli_concatenation")],
    "cpp": [Flow(r"\b(?:system|popen|execl|execle|execlp|execv|execve|execvp)\s*\(\s*([^\n;]*)", "security:os_command_injection")],
    "rs": [Flow(r"(?:Command::new|libc::system|\bsystem)\s*\(([^\n;]*)\)", "security:os_command_injection", public=r"\bpub\b")],
    "swift": [Flow(r"(?:NSTask|(?:Foundation\.)?Process|launch\w*|\.arguments\s*=|\.launchPath\s*=)\s*\(?([^\n]*)", "security:os_command_injection")],
    "scala": [Flow(r"(?:getRuntime\(?\)?\s*\.exec|\bProcess)\s*\(([^\n]*)\)", "security:os_command_injection")],
    "sh": [Flow(r"(?m)^[^#\n]*\b(?:eval|exec)\s+([^\n]*)", "security:eval_injection", sources=r"\$(?:[1-5@*])", sigil="$", whole=True)],
    "nix": [Flow(r"builtins\.exec\s*([^\n;]*)", "security:nix_exec_injection")],
    "hcl": [Flow(r"(?m)^\s*(?:command|program)\s*=\s*([^\n]*)", "security:provisioner_command_injection", sources=r"(?:var|local)\.[A-Za-z_]\w*", whole=True)],
    "lua": [Flow(r"(?:os\.execute|io\.popen)\s*\(([^\n]*)\)", "security:command_injection")],
    "gd": [Flow(r"OS\.(?:execute|shell_open)\s*\(([^\n]*)\)", "security:command_injection")],
    "zig": [Flow(r"(?:ChildProcess\.(?:init|exec|run)|process\.Child\.\w+)\s*\(([^\n]*)\)", "security:zig_exec_injection")],
    "m": [Flow(r"(?:\bsystem\s*\(|NSTask|setLaunchPath:|setArguments:|\bpopen\s*\()([^\n]*)", "security:os_command_injection")],
    "glsl": [Flow(r"\b(?:imageStore|texelFetch|texture2D|texture)\s*\(([^\n;]*)\)", "security:glsl_tainted_access", sources=r"(?m)^\s*(?:uniform|varying|in)\s+\w+\s+(\w+)", whole=True)],
}
_ASSIGN = re.compile(r"(?:\b(?:let|var|const|val|local|my|auto|char|int|String|string|NSString|std::string)\b[\s*]*(?:mut\s+)?)?(\$?[A-Za-z_]\w*)\s*(?::\s*[\w<>?&\[\]]+\s*)?(?::=|=|<-)(?!=)\s*(.+)")
_CLEANED = re.compile(r"(?i)\b\w*(?:sanitiz|escape|quote|validate|whitelist|allowlist|parseInt|Atoi|to_i|intval|shellescape)\w*\s*\(")


def _uses(text: str, names) -> str | None:
    """The first of some names that a text uses."""
    return next((n for n in names if re.search(rf"(?<![\w$]){re.escape(n)}(?!\w)", text)), None)


def flows(lang: str, text: str) -> Iterator[tuple[str, str, int, str]]:
    """(rule id, name, place, function) of untrusted names that reach a sink."""
    if lang == "hcl":
        yield from _hcl_flows(text)
        return
    code = blanked(text, lang)
    functions = [e for e in entities(text, lang) if e.kind == "function"]
    for flow in FLOWS.get(lang, ()):
        spans = [("", 0, len(code), [])] if flow.whole else [(e.qualified, e.body, e.end, e.params) for e in functions if not flow.public or re.search(flow.public, code[code.rfind("\n", 0, e.start) + 1 : e.start + 4])]
        seen = set()
        for name, begin, end, params in spans:
            dirty = [flow.sigil + p.lstrip("$") for p in params if p not in ("self", "cls", "this")]
            found = re.finditer(flow.sources, code[begin:end]) if flow.sources else ()
            dirty += [s for s in dict.fromkeys((m[1] if m.groups() else m[0]) for m in found) if s not in dirty]
            for line in re.finditer(r"[^\n]+", code[begin:end]):
                for s in re.finditer(flow.sink.replace("(?m)^", "^"), line[0]):
                    hit = _uses(s[1], dirty) or next((d for d in dirty if not d[-1:].isalnum() and d in s[1]), None)
                    key = (begin + line.start(), flow.id)
                    if hit and not _CLEANED.search(s[1]) and key not in seen:
                        seen.add(key)
                        yield flow.id, hit, begin + line.start() + s.start(), name
                a = _ASSIGN.search(line[0])
                if a:
                    left = flow.sigil + a[1].lstrip("$") if flow.sigil else a[1]
                    tainted = _uses(a[2], dirty) or any(not d[-1:].isalnum() and d in a[2] for d in dirty)
                    if tainted and not _CLEANED.search(a[2]):
                        if left not in dirty:
                            dirty.append(left)
                    elif left in dirty and left not in params:
                        dirty.remove(left)


def _hcl_flows(text: str) -> Iterator[tuple[str, str, int, str]]:
    """Variables in the command of a local provisioner or an external data source."""
    for block in re.finditer(r"(provisioner|data)\s+\"(local-exec|external)\"[^{\n]*\{", text):
        end = syntax._closing(text, block.end() - 1)
        for m in re.finditer(r"(?m)^\s*(?:command|program)\s*=\s*([^\n]*)", text[block.end() : end]):
            used = re.search(r"\b((?:var|local)\.\w+)", m[1])
            if used:
                id_ = "security:provisioner_command_injection" if block[1] == "provisioner" else "security:terraform_external_exec"
                yield id_, used[1], block.end() + m.start(1), block[2]


# Where a page takes values from outside, and what takes configuration.
PAGE_INPUTS = (("URLSearchParams", r"URLSearchParams\(|\.get(?:All)?\("), ("window.location.hash", r"location\.hash"), ("window.location.search", r"location\.search"), ("postMessage event.data", r"\b(?:event|e|msg|message)\.data\b"), ("document.cookie", r"document\.cookie"))


def config_flows(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(property path, input, variable, place) of outside values that reach a configuration object's property."""
    code = blanked(text, "js")
    dirty = {}
    for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*([^;\n]+)", code):
        kind = next((name for name, pattern in PAGE_INPUTS if re.search(pattern, m[2])), None) or next((dirty[v] for v in dirty if re.search(rf"\b{v}\b", m[2])), None)
        if kind:
            dirty[m[1]] = kind
    seen = set()
    for m in re.finditer(r"\b((?:options|config|settings|opts|theme|lock|auth0?)(?:\.\w+)+)\s*=\s*([^;\n]+)", code):
        for v, kind in dirty.items():
            if re.search(rf"\b{v}\b", m[2]) and (m[1], kind) not in seen:
                seen.add((m[1], kind))
                yield m[1], kind, v, m.start()


def exports(lang: str, path: str, text: str) -> Iterator[tuple]:
    """(file, symbol, parameter, reaches a sink, calls) of what a file offers to others."""
    code = blanked(text, lang)
    public = {"js": r"\bexport\b|module\.exports", "java": r"\bpublic\b", "cs": r"\bpublic\b", "rs": r"\bpub\b", "scala": "", "php": ""}.get(lang, "")
    hits = {(name, function) for _, name, _, function in flows(lang, text)}
    for e in entities(text, lang):
        head = code[code.rfind("\n", 0, e.start) + 1 : e.start + len(e.name) + 8]
        outer = "." not in e.qualified or lang in ("java", "cs")
        offered = e.kind == "function" and outer and (re.search(public, head) if public else not e.name.startswith("_")) and not (lang == "go" and not e.name[:1].isupper())
        if offered:
            for p in e.params:
                if p not in ("self", "cls", "this"):
                    reaches = (p, e.qualified) in hits or any(p2.lstrip("$") == p.lstrip("$") and f == e.qualified for p2, f in hits)
                    yield path, e.name, p, reaches, sorted({c.callee for c in calls(code[e.body : e.end], blanked(text, lang, True)[e.body : e.end]) if any(_uses(a, [p]) for a in c.args)})


def facts(lang: str, text: str) -> Iterator[tuple]:
    """Canonical facts of a file: (function, kind, name, detail, line), kind one of param, assign, call, return."""
    code, bare = blanked(text, lang), blanked(text, lang, True)
    for e in entities(text, lang):
        if e.kind != "function":
            continue
        yield from ((e.qualified, "param", p, "", _line(text, e.start)) for p in e.params)
        for line in re.finditer(r"[^\n]+", code[e.body : e.end]):
            at = _line(text, e.body + line.start())
            a = _ASSIGN.search(line[0])
            if a:
                yield e.qualified, "assign", a[1], a[2].strip().rstrip(";")[:200], at
            if r := re.match(r"\s*return\b\s*([^;\n}]*)", line[0]):
                yield e.qualified, "return", r[1].strip()[:200], "", at
        for c in calls(code[e.body : e.end], bare[e.body : e.end]):
            yield e.qualified, "call", c.callee, ", ".join(c.args)[:200], _line(text, e.body + c.start)


# --- further languages --------------------------------------------------------------------


def _python(text: str, code: str) -> Iterator[tuple]:
    """Environment, command output or high-entropy bytes sent to a trusted service's API."""
    bound = {m[1] for m in re.finditer(r"(\w+)\s*=\s*[^\n]*(?:os\.environ|subprocess\.\w+|check_output|popen\()", code)}
    bound |= {m[1] for m in re.finditer(r"(\w+)\s*=\s*([^\n]+)", code) if any(re.search(rf"\b{b}\b", m[2]) for b in bound)}
    trusted = r"(?:api\.)?(?:slack|discord|telegram|github|dropbox|notion|trello|pastebin|google)\w*\.(?:com|org)|hooks\.slack\.com|discord\.com/api/webhooks"
    apis = {m[1] for m in re.finditer(rf"(\w+)\s*=\s*[\"'][^\"'\n]*(?:{trusted})", code)}
    for c in calls(code, blanked(text, "py", True)):
        if re.fullmatch(r"requests\.(?:post|put|patch)|.*\.(?:send_message|chat_postMessage|post)|urlopen", c.callee):
            rest = ", ".join(c.args)
            if (re.search(trusted, rest) or any(_uses(rest, [a]) for a in apis) or "chat_postMessage" in c.callee) and (any(_uses(rest, [b]) for b in bound) or re.search(r"os\.environ|check_output", rest)):
                yield "security:lotl_api_c2_exfiltration", "KevCritical", c.start, c.callee


def _script(text: str, code: str) -> Iterator[tuple]:
    """Child processes under another name, run on decoded text; unsafe merges of parsed input."""
    aliases = {m[1] for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*require\([\"'](?:node:)?child_process[\"']\)", code)}
    names = {n.split(":")[-1].strip() for m in re.finditer(r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*require\([\"'](?:node:)?child_process[\"']\)", code) for n in m[1].split(",")}
    coded = r"atob\s*\(|Buffer\.from\s*\([^)]*(?:base64|hex)|String\.fromCharCode|unescape\s*\(|decodeURIComponent\s*\("
    held = {m[1] for m in re.finditer(rf"(?:const|let|var)\s+(\w+)\s*=\s*[^;\n]*(?:{coded})", code)}
    for c in calls(code, blanked(text, "js", True)):
        method = c.callee.split(".")[-1]
        runs = (c.callee.split(".")[0] in aliases and method in ("exec", "execSync", "spawn", "spawnSync", "execFile")) or c.callee in names or c.callee in ("eval", "new Function", "Function")
        if runs and c.args and (re.search(coded, c.args[-1] if "Function" in c.callee else c.args[0]) or _uses(c.args[0], held)):
            yield "security:obfuscated_payload_execution", "KevCritical", c.start, c.callee
        if c.callee in ("_.merge", "lodash.merge", "_.defaultsDeep", "lodash.defaultsDeep", "$.extend", "jQuery.extend", "Object.assign", "deepmerge") and any(re.search(r"JSON\.parse|req\.(?:body|query|params)", a) for a in c.args):
            if not any("sanitize" in e.name.lower() or "validate" in e.name.lower() for e in entities(text, "js") if e.start <= c.start < e.end):
                yield "security:prototype_pollution_merge_sink", "Critical", c.start, c.callee


def _c(text: str, code: str) -> Iterator[tuple]:
    """Loops one too far, uses and frees after a free, indexes from outside without a bound."""
    for m in re.finditer(r"for\s*\(([^;]*);([^;]*<=[^;]*);[^)]*\)\s*(\{?)", code):
        variable = re.match(r"\s*(\w+)\s*<=", m[2])
        end = syntax._closing(code, m.end() - 1) if m[3] else code.find(";", m.end())
        if variable and re.search(rf"\w+\s*\[\s*{variable[1]}\s*\]\s*=(?!=)", code[m.end() : end]):
            yield "security:lcm_off_by_one_loop", "Critical", m.start(), m[2].strip()
    for e in entities(text, "cpp"):
        if e.kind != "function":
            continue
        body = code[e.body : e.end]
        for f in re.finditer(r"\bfree\s*\(\s*(\w+)\s*\)\s*;", body):
            rest, name = body[f.end() :], f[1]
            reset = re.search(rf"\b{name}\s*=\s*", rest)
            use = re.search(rf"\b{name}\s*->|(?<![\w*])\*\s*{name}\b(?!\s*\))|\b{name}\s*\[", rest)
            again = re.search(rf"\bfree\s*\(\s*{name}\s*\)", rest)
            for hit, id_ in ((use, "security:lcm_use_after_free"), (again, "security:lcm_double_free")):
                if hit and not (reset and reset.start() < hit.start()):
                    yield id_, "KevCritical", e.body + f.start(), name
        for p in e.params:
            for s in re.finditer(rf"\w+\s*\[\s*{re.escape(p)}\s*\]\s*=(?!=)|\bmem(?:cpy|move|set)\s*\([^;]*,\s*{re.escape(p)}\s*\)", body):
                before = body[: s.start()]
                if not re.search(rf"(?:if|while|assert|for)\s*\([^)]*\b{re.escape(p)}\s*(?:<|>|<=|>=|==|!=)|(?:<|>|<=|>=)\s*{re.escape(p)}\b", before):
                    yield "security:memory_unproven", "High", e.body + s.start(), p


def _rust(text: str) -> Iterator[tuple]:
    """Functions named or documented as a check whose body checks nothing."""
    code = blanked(text, "rs")
    for e in entities(text, "rs"):
        if e.kind == "function":
            doc = re.search(r"((?:[ \t]*///[^\n]*\n)+)(?:[ \t]*#\[[^\n]*\n)*[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?$", text[: e.start])
            says = re.search(r"verify|authenticate|sanitize|check", e.name.lower()) or (doc and re.search(r"(?i)verify|authenticate|sanitize|check", doc[1]))
            inner = re.sub(r"\s+", " ", code[e.body + 1 : e.end - 1]).strip()
            if says and re.fullmatch(r"|(?:return )?true;?|(?:return )?Ok\(\(\)\);?|(?:return )?Ok\(true\);?|\(\)|todo!\(\);?", inner):
                yield "security:intent_divergence", "KevCritical", e.start, e.name


def _solidity(text: str) -> Iterator[tuple]:
    """Money sent before the books change, unguarded authority, replayed signatures, delegated code, spot prices, loan callbacks."""
    code = blanked(text, "sol")
    state = {m[1] for m in re.finditer(r"(?m)^\s*(?:mapping\s*\([^;]*\)|u?int\d*|address|bool)\s+(?:public\s+|private\s+|internal\s+|immutable\s+|constant\s+)*(\w+)\s*(?:=[^;]*)?;", code)}
    functions = [(e, code[code.rfind("\n", 0, e.start) + 1 : e.end], code[e.body : e.end]) for e in entities(text, "sol") if e.kind == "function"]
    for e, whole, body in functions:
        low = whole.lower()
        guarded = bool(re.search(r"onlyowner|onlyrole|requiresauth|(?:require|if)\s*\(\s*msg\.sender|_checkowner\(|_authorizeupgrade\(", low))
        send = re.search(r"\.call\.value\s*\(|\.call\s*\{\s*value\s*:", body)
        if send and "nonreentrant" not in low:
            after = [x for x in body[send.end() :].split("\n") if re.search(r"(?<![=!<>])=(?!=)|\+=|-=|\+\+|--", x) and not re.match(r"\s*(?://|require|emit |return|\(?bool)", x)]
            if any(_uses(x, state) for x in after):
                yield "security:reentrancy", "KevCritical", e.body + send.start(), e.name
            else:
                read = [v for v in state if re.search(rf"\b{v}\b", body[: send.start()])]
                for other, w2, b2 in functions:
                    hit = next((v for v in read if other is not e and "nonreentrant" not in w2.lower() and re.search(rf"\b{v}\b(?:\[[^\]]*\])?\s*(?:=(?!=)|\+=|-=)", b2)), None)
                    if hit:
                        yield "security:cross_function_reentrancy", "KevCritical", e.body + send.start(), f"{e.name} {other.name} {hit}"
                        break
        for m in re.finditer(r"selfdestruct\s*\(|suicide\s*\(|function\s+upgradeTo(?:AndCall)?\s*\(", whole):
            if not guarded:
                yield "security:unprotected_authority_transition", "KevCritical", e.start, m[0].strip(" (")
        if "ecrecover(" in low and (not re.search(r"nonces\[|usednonce|used_nonce|nonce\+\+|nonce \+= |nonce = ", low) or "block.chainid" not in low):
            yield "security:signature_replay", "KevCritical", e.body + body.lower().find("ecrecover("), e.name
        for m in re.finditer(r"(\w+)\.delegatecall\s*[({]", body):
            if not guarded and (m[1] in e.params or "msg.sender" in m[0]):
                yield "security:unsafe_delegatecall", "KevCritical", e.body + m.start(), m[1]
        spot = re.search(r"\.balanceof\(|balanceof\(address\(this\)\)|getreserves\(\)|slot0\(\)", low)
        averaged = re.search(r"twap|chainlink|latestrounddata|consult\(|pricecumulative|timeweighted|time-weighted", low)
        if spot and not averaged and re.search(r"price|amountout|amount_out|outamount|return ", low) and re.search(r" \* | / ", body):
            yield "security:oracle_price_manipulation", "KevCritical", e.start, e.name
        if re.search(r"onflashloan|executeoperation|uniswapv\dcall|pancakecall|flashcallback", e.name.lower()) and not re.search(r"require\s*\(\s*msg\.sender|if\s*\(\s*msg\.sender|initiator\s*==", whole):
            yield "security:flash_loan_callback_unvalidated_sender", "KevCritical", e.start, e.name


def _latex(text: str) -> Iterator[tuple]:
    """Comments that address a model."""
    for m in re.finditer(r"(?m)(?<!\\)%([^\n]*)", text):
        if re.search(r"ignore|system instruction|override", m[1].lower()):
            yield "security:camoleak_payload", "Critical", m.start(), m[1].strip()[:80]


_MODELS = re.compile(r"(?m)^kind:\s*(\w+)")


def _yaml(text: str) -> Iterator[tuple]:
    """Open hosts, private routes without isolation, routes that are up before their policy."""
    at = 0
    documents = re.split(r"(?m)^---[^\n]*$", text)
    policies = any((m := _MODELS.search(d)) and m[1] == "AuthorizationPolicy" and re.search(r"action:\s*DENY", d) for d in documents)
    for doc in documents:
        start = text.find(doc, at)
        at = start + len(doc)
        kind = _MODELS.search(doc)
        if not kind:
            continue
        low = doc.lower()
        if kind[1] in ("VirtualService", "Ingress", "Gateway", "HTTPRoute") and (m := re.search(r"(?m)^\s*(?:hosts:\s*\[\s*[\"']?\*[\"']?|-?\s*host:\s*[\"']?\*[\"']?\s*$)|hosts:\s*\n(?:\s*-[^\n]*\n)*?\s*-\s*[\"']?\*[\"']?\s*$", doc)):
            yield "security:k8s_wildcard_host", "Critical", start + m.start(), kind[1]
        private = re.search(r"private|internal|cluster-local", low)
        isolated = re.search(r"ingress\.class: internal|ingressclassname: internal|scheme: internal|load-balancer-internal: [\"']?true", low)
        if kind[1] in ("Ingress", "Gateway", "VirtualService") and private and not isolated:
            yield "security:crd_exposure_drift", "KevCritical", start + kind.start(), kind[1]
        if kind[1] == "VirtualService" and re.search(r"(?m)^\s+http:", doc) and not policies:
            yield "security:cloud_perimeter_timing_gap", "High", start + kind.start(), "no timeout" if "timeout:" not in doc else "no deny policy"
        if kind[1] == "AuthorizationPolicy" and re.search(r"action:\s*ALLOW", doc) and not policies:
            yield "security:cloud_perimeter_timing_gap", "High", start + kind.start(), "allow without deny"
        if kind[1] == "EnvoyFilter" and re.search(r"operation:\s*(?:MERGE|INSERT_BEFORE|ADD)", doc) and not policies:
            yield "security:cloud_perimeter_timing_gap", "High", start + kind.start(), "filter without deny"


def _hcl(text: str) -> Iterator[tuple]:
    """Open networks, public buckets, wildcard roles, fixed credentials, open stages."""
    for block in re.finditer(r"(?m)^(resource|provider)\s+\"(\w+)\"[^{\n]*\{", text):
        body = text[block.end() : syntax._closing(text, block.end() - 1)]
        if "security_group" in block[2] and (m := re.search(r"cidr_blocks\s*=\s*\[[^\]]*\"0\.0\.0\.0/0\"", body)):
            yield "security:open_cidr", "Critical", block.end() + m.start(), block[2]
        if "s3" in block[2] and (m := re.search(r"acl\s*=\s*\"public-read(?:-write)?\"", body)):
            yield "security:s3_public_acl", "Critical", block.end() + m.start(), block[2]
        recon = "iam" in block[2] and re.search(r"\"?Action\"?\s*[=:]\s*\[?\s*\"\*\"", body)
        recon = recon or (block[1] == "provider" and re.search(r"(?:access_key|secret_key|password|token)\s*=\s*\"(?!\$|var)[^\"]+\"", body))
        recon = recon or ("snowflake_stage" in block[2] and not re.search(r"credentials|storage_integration", body) and re.search(r"url\s*=", body))
        if recon:
            yield "security:iac_agentic_recon_target", "Critical", block.end() + recon.start(), block[2]


def jwt_wrappers(lang: str, text: str) -> Iterator[tuple]:
    """Calls of functions that pass their options on to a token check, with options that switch it off."""
    code, bare = blanked(text, lang), blanked(text, lang, True)
    wrappers = {}
    for e in entities(text, lang):
        inner = re.search(r"\bjwt\.(?:verify|decode)\s*\(([^\n]*)\)", code[e.body : e.end]) if e.kind == "function" else None
        if inner:
            passed = [i for i, p in enumerate(e.params) if re.search(rf"\b{re.escape(p)}\b", inner[1].partition(",")[2])]
            if passed:
                wrappers[e.name] = passed
    for c in calls(code, bare):
        for i in wrappers.get(c.callee.split(".")[-1], ()):
            if i < len(c.args) and re.search(r"(?i)[\"']none[\"']|verify(?:_signature)?[\"']?\s*[:=]\s*false|ignoreExpiration\s*:\s*true", c.args[i]):
                yield "security:jwt_wrapper_polymorphism", "KevCritical", c.start, c.callee


# --- all rules of a file ----------------------------------------------------------------


def findings_of(path: str, text: str) -> list[tuple]:
    """(path, id, severity, line, detail) of one file, by place."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    out: list[tuple] = []
    lang = language_of(path)
    if lang:
        code, bare = blanked(text, lang), blanked(text, lang, True)
        tests = [(e.start, e.end) for e in entities(text, lang) if e.kind == "function" and re.match(r"(?i)test|.*_spec$", e.name)]
        out += _of_calls(lang, code, bare, tests)
        out += _of_patterns(lang, code)
        out += _of_near(lang, code)
        out += _of_units(lang, code)
        out += [(id_, "KevCritical", at, f"{function}: {name}".lstrip(": ")) for id_, name, at, function in flows(lang, text)]
        if lang == "py":
            out += _python(text, code)
        if lang == "js":
            out += _script(text, code)
            out += [("security:config_taint", "Critical", at, f"{prop} from {kind}") for prop, kind, _, at in config_flows(text)]
        if lang in ("py", "js"):
            out += jwt_wrappers(lang, text)
        if lang == "cpp":
            out += _c(text, code)
        if lang == "rs":
            out += _rust(text)
        if lang == "sol":
            out += _solidity(text)
    elif base.endswith((".tf", ".hcl")):
        out += _hcl(text)
        out += [(id_, "KevCritical", at, name) for id_, name, at, _ in _hcl_flows(text)]
    elif base.endswith((".yaml", ".yml")):
        out += _yaml(text)
    elif base.endswith((".tex", ".sty")):
        out += _latex(text)
    rows = sorted({(at, id_, severity, detail) for id_, severity, at, detail in out})
    return [(path, id_, severity, _line(text, at), detail) for at, id_, severity, detail in rows]


def findings(files: DataFrame) -> DataFrame:
    """The findings of all rules here over files (path, content)."""
    return per_file(files, findings_of, FINDINGS)


def _export_rows(path: str, text: str) -> list[tuple]:
    lang = language_of(path)
    return [(p, s, a, r, c) for p, s, a, r, c in exports(lang, path, text)] if lang else []


def export_records(files: DataFrame) -> DataFrame:
    """What files offer: path, symbol, param, reaches_sink, calls."""
    return per_file(files, _export_rows, "path string, symbol string, param string, reaches_sink boolean, calls array<string>")


def _fact_rows(path: str, text: str) -> list[tuple]:
    lang = language_of(path)
    return [(path, *f) for f in facts(lang, text)] if lang else []


def canonical_facts(files: DataFrame) -> DataFrame:
    """Facts of all functions, the input of `graph.taint`."""
    return per_file(files, _fact_rows, "path string, function string, kind string, name string, detail string, line int")


def cross_file_sinks(calls_: DataFrame, catalog: DataFrame) -> DataFrame:
    """Call sites whose symbol the catalogue of exports knows to reach a sink."""
    bad = catalog.where("reaches_sink").select(F.col("symbol").alias("callee")).distinct()
    return calls_.join(bad, "callee", "left_semi")


# --- endpoints ------------------------------------------------------------------------------

ENDPOINTS = "path string, method string, route string, handler string, controller string, auth string, line int"
_AUTH_WORDS = r"(?i)auth|login|permission|role|secured|jwt|guard|protect"


def _endpoint_rows(path: str, text: str) -> list[tuple]:
    lang, out = language_of(path), []
    if lang not in ("py", "js", "java"):
        return []
    code = blanked(text, lang)
    defined = entities(text, lang)

    def auth(part: str, marks: str) -> str | None:
        return next((m[1] for m in re.finditer(marks, part) if re.search(_AUTH_WORDS, m[1])), None)

    if lang == "js":
        for m in re.finditer(r"\b(\w+)\.(get|post|put|delete|patch)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*([^\n]*)", code):
            middle = [a for a in re.split(r",\s*", re.sub(r"\)\s*;?\s*$", "", m[4])) if re.match(r"[\w.]+(?:\([^)]*\))?$", a.strip())]
            out.append((path, m[2].upper(), m[3], (middle[-1] if middle else None), m[1], next((a for a in middle if re.search(_AUTH_WORDS, a)), None), _line(text, m.start())))
        return out
    pattern = r"@(?:\w+\.)?(get|post|put|delete|patch|route)\s*\(\s*[\"']([^\"']+)[\"']([^\n]*)" if lang == "py" else r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"([^\n]*))?"
    for m in re.finditer(pattern, code):
        after = next((e for e in defined if e.kind == "function" and e.start >= m.start()), None)
        if after is None or (lang == "java" and m[1] == "Request" and re.match(r"[^;{]*\bclass\b", code[m.end() :])):
            continue
        outer = next((e for e in reversed(defined) if e.kind == "class" and e.start < m.start() < e.end), None)
        begin = max(code.rfind("\n\n", 0, m.start()), code.rfind("}", 0, m.start()), code.rfind("{", 0, m.start()), 0)
        method = re.search(r"methods\s*=\s*\[\s*[\"'](\w+)", m[3] or "")
        kind = (method[1] if method else "GET" if m[1] in ("route", "Request") else m[1]).upper()
        out.append((path, kind, m[2] or "", after.name, outer.name if outer else None, auth(code[begin : after.body], r"@([\w.]+)"), _line(text, m.start())))
    return out


def endpoints(files: DataFrame) -> DataFrame:
    """What controllers serve: method, route, handler, controller, the authorization that is asked for."""
    return per_file(files, _endpoint_rows, ENDPOINTS)


def _route_rows(path: str, text: str) -> list[tuple]:
    if language_of(path) != "js":
        return []
    found = {m[1]: m[2] for m in re.finditer(r"import\s+(\w+)\s+from\s+[\"']([^\"']+)[\"']", text)}
    out = []
    for m in re.finditer(r"<Route\b[^>]*\bpath=[\"'{]+([^\"'}]+)[\"'}]+[^>]*?(?:element=\{<(\w+)|component=\{(\w+))", text):
        component = m[2] or m[3]
        out.append((path, m[1], component, found.get(component), _line(text, m.start())))
    for m in re.finditer(r"\{\s*path:\s*[\"']([^\"']+)[\"'][^{}]*?component:\s*(?:(\w+)|\(\)\s*=>\s*import\([\"']([^\"']+)[\"']\))", text):
        out.append((path, m[1], m[2], found.get(m[2]) if m[2] else m[3], _line(text, m.start())))
    return sorted(set(out), key=lambda r: r[4])


def frontend_routes(files: DataFrame) -> DataFrame:
    """Routes of a page's router: route, component, component_file."""
    return per_file(files, _route_rows, "path string, route string, component string, component_file string, line int")


def route_of_file(routes: DataFrame, files: DataFrame) -> DataFrame:
    """The first route that shows each file, by the component's file, or by its name."""
    stem = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[jt]sx?$", ""))
    names = routes.select("route", "line", F.explode(F.array_distinct(F.array_compact(F.array(stem(F.col("component_file")), F.lower("component"))))).alias("stem"))
    first = names.groupBy("stem").agg(F.min_by("route", F.struct("line", "route")).alias("route"))
    return files.select("path", stem(F.col("path")).alias("stem")).join(first, "stem").select("path", "route")


def _router_rows(path: str, text: str) -> list[tuple]:
    if language_of(path) != "js":
        return []
    out = []
    for m in re.finditer(r"\b(\w+)\.use\s*\(\s*(?:[\"'`]([^\"'`]*)[\"'`]\s*,\s*)?([^\n;]*)\)", text):
        for arg in _split(m[3]):
            kind = "mount" if re.search(r"(?i)router|routes", arg) else "middleware"
            out.append((path, m[1], kind, arg.strip(), m[2], _line(text, m.start())))
    return out


def router_topology(files: DataFrame) -> DataFrame:
    """What routers use: path, router, kind (mount or middleware), name, prefix; `graph.inherited` takes it up."""
    return per_file(files, _router_rows, "path string, router string, kind string, name string, prefix string, line int")


def missing_authz(found: DataFrame) -> DataFrame:
    """Endpoints without the authorization that four fifths of their controller's endpoints ask for."""
    group = ["path", F.coalesce("controller", F.lit("file")).alias("controller")]
    asked = found.groupBy(*group, F.coalesce("auth", F.lit("")).alias("auth")).agg(F.count("*").alias("n"))
    most = asked.groupBy("path", "controller").agg(F.sum("n").alias("total"), F.max_by("auth", F.struct("n", "auth")).alias("expected"), F.max(F.struct("n", "auth")).alias("m"))
    strict = most.where("total >= 2 AND expected != '' AND m.n * 5 >= total * 4").select("path", "controller", "expected")
    each = found.withColumn("controller", F.coalesce("controller", F.lit("file"))).join(strict, ["path", "controller"])
    return each.where("auth IS NULL").select("path", "method", "route", "line", "expected")


# Fixed values, lower case: who asks, what looks things up, what binds the two.
PRINCIPALS = ("current_user.id", "session.userid", "session.user.id", "req.user.id", "req.user?.id", "res.locals.user.id", "claims.sub", "jwt.sub", "token.sub", "principal.id", "principal.getid(", "authentication.getname(", "auth.uid", "subject")
LOOKUPS = ("select ", ".query(", ".execute(", ".filter(", ".filter_by(", ".where(", ".find(", ".findone(", ".findunique(", ".findbyid(", ".findbypk(", ".get(", "repository.find", "repo.find", "db.session.get", "db.get(", "jdbctemplate", "preparestatement(", "entitymanager.find")
OWNERS = ("owner_id", "user_id", "account_id", "principal_id", "subject_id", "tenant_id", "member_id")


def _ownership_rows(path: str, text: str) -> list[tuple]:
    lang, out = language_of(path), []
    served = _endpoint_rows(path, text)
    for _, method, route, handler, _, _, line in served:
        if not re.search(r":\w+|\{\w+\}|<[\w:]+>", route):
            continue
        e = next((x for x in entities(text, lang) if x.kind == "function" and x.name == handler), None) if lang else None
        begin = sum(len(x) + 1 for x in text.split("\n")[: line - 1])
        body = (text[e.body : e.end] if e else text[begin : syntax._closing(text, text.index("(", begin))] if "(" in text[begin:] else "").lower()
        if any(x in body for x in LOOKUPS) and not any(x in body for x in PRINCIPALS) and not any(x in body for x in OWNERS):
            out.append((path, method, route, handler, line))
    return out


def missing_ownership(files: DataFrame) -> DataFrame:
    """Endpoints with a parameter in their route whose handler looks it up without binding it to who asks."""
    return per_file(files, _ownership_rows, "path string, method string, route string, handler string, line int")
