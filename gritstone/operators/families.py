"""Detector families as data. A family may have several rules; a guard within the radius silences a match."""

from __future__ import annotations

from gritstone.operators.detect import Rule

_REQ = r"\b(?:req|request|ctx)\s*\."
_WEB = "js py"

FAMILIES: tuple[Rule, ...] = (
    Rule("csrf", "CWE-352", "high", "js", r"\b(?:app|router|server|fastify)\s*\.\s*(?:post|put|patch|delete)\s*\(", r"(?i)csrf|csurf|samesite\s*[:=]\s*['\"](?:strict|lax)|\bauthorization\b|jwt\.verify", 15),
    Rule("csrf", "CWE-352", "high", "py", r"@\w+\s*\.\s*route\s*\([^)]*methods\s*=\s*\[[^\]]*['\"](?:POST|PUT|PATCH|DELETE)", r"(?i)csrf|\bauthorization\b", 15),
    Rule("csrf", "CWE-352", "high", "java", r"@(?:Post|Put|Patch|Delete)Mapping\b", r"(?i)csrf|bearer", 15),
    Rule("template-injection", "CWE-94", "critical", "py", rf"\bfrom_string\s*\(\s*[^)'\"]*{_REQ}"),
    Rule("template-injection", "CWE-94", "critical", "js", rf"\b(?:ejs|pug|Handlebars)\s*\.\s*(?:compile|render)\s*\(\s*{_REQ}"),
    Rule("sql-injection", "CWE-89", "critical", _WEB, r"\b(?:execute|query|raw)\s*\(\s*(?:f['\"][^'\"\n]*\{|['\"][^'\"\n]*['\"]\s*[+%]|`[^`]*\$\{)"),
    Rule("sql-injection", "CWE-89", "critical", "java php", r"\b(?:executeQuery|mysqli_query|createQuery)\s*\([^;\"]*\"[^\"\n]*\"\s*[+.]\s*\$?\w"),
    Rule("command-injection", "CWE-78", "critical", "py", r"\b(?:os\.system|subprocess\.\w+)\s*\(\s*(?:f['\"]|[^)\n]*\+\s*\w)"),
    Rule("command-injection", "CWE-78", "critical", "js", r"\b(?:exec|execSync)\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"\n]*['\"]\s*\+)"),
    Rule("code-injection", "CWE-95", "critical", _WEB, rf"\b(?:eval|exec|Function)\s*\(\s*[^)\n]*{_REQ}"),
    Rule("xss", "CWE-79", "high", "js", r"\.(?:innerHTML|outerHTML)\s*=\s*(?!\s*['\"][^'\"\n]*['\"]\s*;)[^\n;]+", r"DOMPurify|sanitize|escapeHtml", 3),
    Rule("path-traversal", "CWE-22", "high", "js", rf"\b(?:readFile|readFileSync|sendFile|createReadStream)\s*\(\s*[^)\n]*{_REQ}", r"\bbasename\s*\(|\bnormalize\s*\(", 5),
    Rule("path-traversal", "CWE-22", "high", "py", rf"\bopen\s*\(\s*[^)\n]*{_REQ}", r"secure_filename|\bbasename\s*\(", 5),
    Rule("ssrf", "CWE-918", "high", "js", rf"\b(?:fetch|axios(?:\.\w+)?|got)\s*\(\s*{_REQ}", r"(?i)allow_?list|allowedhost", 5),
    Rule("ssrf", "CWE-918", "high", "py", rf"\brequests\.\w+\s*\(\s*{_REQ}", r"(?i)allow_?list|allowed_host", 5),
    Rule("open-redirect", "CWE-601", "medium", _WEB, rf"\bredirect\s*\(\s*{_REQ}", r"startsWith\s*\(\s*['\"]/|url_has_allowed_host", 5),
    Rule("xxe", "CWE-611", "high", "py", r"\betree\s*\.\s*(?:parse|fromstring)\s*\(", r"resolve_entities\s*=\s*False|defusedxml"),
    Rule("xxe", "CWE-611", "high", "java", r"\bDocumentBuilderFactory\s*\.\s*newInstance\s*\(", r"disallow-doctype-decl"),
    Rule("deserialization", "CWE-502", "critical", "py", r"\b(?:pickle|marshal)\s*\.\s*loads?\s*\(|\byaml\s*\.\s*load\s*\((?![^)]*SafeLoader)"),
    Rule("deserialization", "CWE-502", "critical", "java", r"\bnew\s+ObjectInputStream\s*\(", r"ObjectInputFilter"),
    Rule("deserialization", "CWE-502", "critical", "php", r"\bunserialize\s*\(\s*\$_(?:GET|POST|COOKIE|REQUEST)"),
    Rule("weak-hash", "CWE-327", "medium", "js py java", r"\bhashlib\s*\.\s*(?:md5|sha1)\b|\bcreateHash\s*\(\s*['\"](?:md5|sha1)['\"]|\bMessageDigest\s*\.\s*getInstance\s*\(\s*\"(?:MD5|SHA-?1)\""),
    Rule("weak-random", "CWE-338", "high", "js py java", r"(?i:\b\w*(?:token|secret|password|nonce|otp)\w*\s*=\s*[^\n;]*(?:\bmath\.random|\brandom\.(?:random|randint|choice)|\bnew\s+random\b))"),
    Rule("hardcoded-secret", "CWE-798", "high", "js py java go", r"(?i:\b(?:api_?key|secret|password|passwd|token)\b\s*:?=\s*['\"][A-Za-z0-9+/_=-]{12,}['\"])", r"(?i)example|placeholder|changeme", 0),
    Rule("mass-assignment", "CWE-915", "medium", "js", r"\.(?:create|update|assign)\s*\(\s*(?:\w+\s*,\s*)?req\s*\.\s*body\s*\)"),
    Rule("mass-assignment", "CWE-915", "medium", "py", r"\*\*\s*request\s*\.\s*(?:json|form|data|POST)\b"),
    Rule("prototype-pollution", "CWE-1321", "high", "js", rf"(?:\b_\.merge|\bdeepmerge|\$\.extend)\s*\([^)\n]*{_REQ}", r"hasOwnProperty|__proto__", 5),
    Rule("unverified-token", "CWE-347", "critical", _WEB, r"\balgorithms?['\"]?\s*[:=]\s*\[?\s*['\"]none['\"]|verify_signature['\"]?\s*:\s*False"),
    Rule("tls-unchecked", "CWE-295", "high", "js py go", r"\brejectUnauthorized\s*:\s*false|\bverify\s*=\s*False|\bInsecureSkipVerify\s*:\s*true"),
    Rule("cookie-flags", "CWE-614", "low", "js", r"\bres\s*\.\s*cookie\s*\(", r"\bsecure\s*:\s*true", 3),
    Rule("ldap-injection", "CWE-90", "high", "py java", r"\b(?:search|search_s)\s*\([^;\n]*['\"]\([^'\"\n]*=['\"]\s*\+"),
    Rule("xpath-injection", "CWE-643", "high", "py java", r"\b(?:xpath|evaluate)\s*\(\s*['\"]/[^\n;]*['\"]\s*\+"),
    Rule("nosql-injection", "CWE-943", "high", "js", r"\.(?:find|findOne|updateOne)\s*\(\s*(?:req\s*\.\s*(?:body|query)|\{[^}\n]*:\s*req\s*\.)"),
    Rule("secret-in-log", "CWE-532", "medium", "js py", r"\b(?:console\.log|logging\.\w+|logger\.\w+|print)\s*\([^)\n]*\b(?:password|secret|token|ssn)\b(?!['\"])"),
    Rule("zip-slip", "CWE-22", "high", "py", r"\.extractall\s*\(", r"commonpath|is_within|filter\s*=\s*['\"]data", 10),
    Rule("buffer-overflow", "CWE-120", "high", "c", r"\b(?:strcpy|strcat|sprintf|gets)\s*\("),
    Rule("response-splitting", "CWE-113", "medium", "js php", r"\b(?:setHeader|header)\s*\([^)\n]*(?:\breq\s*\.|\$_GET)"),
    Rule("no-rate-limit", "CWE-307", "medium", "js", r"\.post\s*\(\s*['\"]/(?:login|signin|token)\b", r"(?i)ratelimit|rate-limit|slowdown"),
    Rule("host-header", "CWE-644", "medium", "js py php", r"\breq\.headers\.host\b|\brequest\.host\b|\$_SERVER\s*\[\s*['\"]HTTP_HOST"),
    Rule("debug-mode", "CWE-489", "low", "py", r"\bapp\.run\s*\([^)\n]*debug\s*=\s*True|(?m:^)DEBUG\s*=\s*True\b"),
    Rule("privileged-container", "CWE-250", "high", "yaml", r"\bprivileged:\s*true\b|\bhostNetwork:\s*true\b|\brunAsUser:\s*0\b"),
    Rule("open-network", "CWE-284", "high", "tf", r"\bcidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\""),
)

NAMES = tuple(dict.fromkeys(r.family for r in FAMILIES))
