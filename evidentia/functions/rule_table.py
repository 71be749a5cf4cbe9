"""Default rules, as fixed values: (ruleset, language, kind, pattern, category, cwe, severity, operation, control), in order of priority."""

# Fixed values. The patterns are what results must agree on; the order within a language and kind is the priority.
RULES = (
    ("injection", "python", "sink", r"os\.system|subprocess\.(call|run|Popen|check_output|check_call)|popen", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "python", "sink", r"^(eval|exec)$|compile", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "python", "sink", r"pickle\.loads?|yaml\.load\(|marshal\.loads?", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "python", "sink", r"\.execute\(|\.executemany\(|\.raw\(|cursor\.execute", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "python", "sink", r"^open$|os\.path\.join|send_file|sendfile", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "python", "sink", r"requests\.(get|post|put|delete)|urlopen|urllib\.request", "Server-Side Request Forgery", "CWE-918", "", "", ""),
    ("injection", "python", "sink", r"render_template_string|Template\(", "Server-Side Template Injection", "CWE-1336", "", "", ""),
    ("injection", "python", "sink", r"^redirect$", "Open Redirect", "CWE-601", "", "", ""),
    ("injection", "python", "sink", r"\.find_one\(|\.find\(\{|\$where", "NoSQL Injection", "CWE-943", "", "", ""),
    ("injection", "python", "sink", r"""\.format\(|f['"]""", "String formatting into a sink (context dependent)", "CWE-74", "", "", ""),
    ("injection", "python", "sink", r"\.xpath\(|etree\.XPath\(|xpath\.compile", "XPath Injection", "CWE-643", "", "", ""),
    ("injection", "python", "sink", r"\.search_s\(|\.search_ext_s\(|\.simple_bind_s\(|ldap\.filter", "LDAP Injection", "CWE-90", "", "", ""),
    ("injection", "python", "sink", r"httpx\.(get|post|put|delete|request)|aiohttp\.|\.request\(", "Server-Side Request Forgery", "CWE-918", "", "", ""),
    ("injection", "python", "source", r"request\.(args|form|json|values|data|files|headers|cookies|get_json)", "HTTP request input (Flask/Django/FastAPI style)", "", "", "", ""),
    ("injection", "python", "source", r"^input$|sys\.argv|sys\.stdin", "CLI / stdin input", "", "", "", ""),
    ("injection", "python", "source", r"os\.environ|getenv", "Environment variable", "", "", "", ""),
    ("injection", "javascript", "sink", r"child_process\.(exec|execSync|spawn|spawnSync)", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "javascript", "sink", r"^eval$|new Function|vm\.runIn", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "javascript", "sink", r"\.query\(|\.execute\(|sequelize\.query", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "javascript", "sink", r"\.findOne\(|\.find\(\{|\.findOneAndUpdate\(|\.aggregate\(|\$where", "NoSQL Injection", "CWE-943", "", "", ""),
    ("injection", "javascript", "sink", r"\.redirect\(", "Open Redirect", "CWE-601", "", "", ""),
    ("injection", "javascript", "sink", r"innerHTML|outerHTML|document\.write|dangerouslySetInnerHTML|insertAdjacentHTML|\.html\(", "Cross-Site Scripting", "CWE-79", "", "", ""),
    ("injection", "javascript", "sink", r"fs\.(readFile|writeFile|unlink|createReadStream|createWriteStream)", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "javascript", "sink", r"JSON\.parse|deserialize|node-serialize", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "javascript", "sink", r"fetch\(|axios\.(get|post)|needle\.(get|post)|http\.request|https\.request", "Server-Side Request Forgery", "CWE-918", "", "", ""),
    ("injection", "javascript", "sink", r"_\.merge\(|_\.mergeWith\(|_\.defaultsDeep\(|\bdeepmerge\(|\bextend\(true|Object\.assign\(|setPrototypeOf", "Prototype Pollution", "CWE-1321", "", "", ""),
    ("injection", "javascript", "sink", r"res\.setHeader\(|res\.writeHead\(|res\.header\(|res\.append\(", "HTTP Response Splitting", "CWE-113", "", "", ""),
    ("injection", "javascript", "sink", r"new RegExp\(", "Regular Expression Denial of Service", "CWE-1333", "", "", ""),
    ("injection", "javascript", "source", r"req\.(query|params|body|headers|cookies)", "HTTP request input (Express-style)", "", "", "", ""),
    ("injection", "javascript", "source", r"process\.env", "Environment variable", "", "", "", ""),
    ("injection", "javascript", "source", r"location\.(search|hash|href)|document\.URL|document\.referrer|window\.name", "Browser-controlled input", "", "", "", ""),
    ("injection", "typescript", "sink", r"child_process\.(exec|execSync|spawn|spawnSync)", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "typescript", "sink", r"^eval$|new Function", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "typescript", "sink", r"\.query\(|\.execute\(|createQueryBuilder", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "typescript", "sink", r"\.findOne\(|\.find\(\{|\.aggregate\(|\$where", "NoSQL Injection", "CWE-943", "", "", ""),
    ("injection", "typescript", "sink", r"\.redirect\(", "Open Redirect", "CWE-601", "", "", ""),
    ("injection", "typescript", "sink", r"innerHTML|bypassSecurityTrust|insertAdjacentHTML", "Cross-Site Scripting", "CWE-79", "", "", ""),
    ("injection", "typescript", "sink", r"fs\.(readFile|writeFile|unlink)", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "typescript", "sink", r"_\.merge\(|_\.defaultsDeep\(|\bdeepmerge\(|Object\.assign\(|setPrototypeOf", "Prototype Pollution", "CWE-1321", "", "", ""),
    ("injection", "typescript", "sink", r"res\.setHeader\(|res\.writeHead\(|res\.header\(", "HTTP Response Splitting", "CWE-113", "", "", ""),
    ("injection", "typescript", "sink", r"new RegExp\(", "Regular Expression Denial of Service", "CWE-1333", "", "", ""),
    ("injection", "typescript", "source", r"req\.(query|params|body|headers|cookies)", "HTTP request input", "", "", "", ""),
    ("injection", "typescript", "source", r"process\.env", "Environment variable", "", "", "", ""),
    ("injection", "java", "sink", r"Runtime\.getRuntime|ProcessBuilder", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "java", "sink", r"executeQuery|executeUpdate|createStatement|createQuery", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "java", "sink", r"readObject|XMLDecoder", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "java", "sink", r"\.eval\(|ScriptEngine", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "java", "sink", r"new File\(|Paths\.get|FileInputStream|FileOutputStream", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "java", "sink", r"DocumentBuilderFactory|SAXParserFactory|XMLInputFactory", "XML External Entity", "CWE-611", "", "", ""),
    ("injection", "java", "sink", r"sendRedirect", "Open Redirect", "CWE-601", "", "", ""),
    ("injection", "java", "sink", r"XPathExpression|newXPath|xpath\.evaluate|\.compile\(.*[xX][pP]ath", "XPath Injection", "CWE-643", "", "", ""),
    ("injection", "java", "sink", r"InitialDirContext|\.search\(|SearchControls", "LDAP Injection", "CWE-90", "", "", ""),
    ("injection", "java", "source", r"getParameter|getHeader|getCookies|getQueryString|getInputStream", "HttpServletRequest input", "", "", "", ""),
    ("injection", "java", "source", r"System\.getenv", "Environment variable", "", "", "", ""),
    ("injection", "go", "sink", r"exec\.Command", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "go", "sink", r"\.Query\(|\.Exec\(|db\.Query|db\.Exec", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "go", "sink", r"os\.Open|ioutil\.ReadFile|filepath\.Join", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "go", "sink", r"template\.HTML|template\.JS", "Cross-Site Scripting", "CWE-79", "", "", ""),
    ("injection", "go", "sink", r"gob\.NewDecoder|json\.Unmarshal", "Insecure Deserialization (context dependent)", "CWE-502", "", "", ""),
    ("injection", "go", "source", r"r\.URL\.Query|r\.FormValue|r\.Header\.Get", "net/http request input", "", "", "", ""),
    ("injection", "go", "source", r"os\.Getenv", "Environment variable", "", "", "", ""),
    ("injection", "php", "sink", r"^(exec|shell_exec|system|passthru|popen|proc_open)$", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "php", "sink", r"mysqli_query|->query\(|PDO::query|->exec\(", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "php", "sink", r"^(eval|assert|create_function)$", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "php", "sink", r"^(include|include_once|require|require_once)$", "Local/Remote File Inclusion", "CWE-98", "", "", ""),
    ("injection", "php", "sink", r"unserialize", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "php", "sink", r"^(fopen|file_get_contents|readfile)$", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "php", "source", r"\$_(GET|POST|REQUEST|COOKIE|SERVER|FILES)", "HTTP superglobal input", "", "", "", ""),
    ("injection", "ruby", "sink", r"system|\`|Kernel\.exec|IO\.popen", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "ruby", "sink", r"\.where\(|find_by_sql|ActiveRecord::Base\.connection\.execute", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "ruby", "sink", r"^eval$|instance_eval|class_eval", "Code Injection", "CWE-95", "", "", ""),
    ("injection", "ruby", "sink", r"Marshal\.load|YAML\.load\(", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "ruby", "sink", r"File\.open|File\.read|send_file", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "ruby", "sink", r"redirect_to", "Open Redirect", "CWE-601", "", "", ""),
    ("injection", "ruby", "source", r"params\[|request\.(query_parameters|headers|cookies)", "Rails request input", "", "", "", ""),
    ("injection", "ruby", "source", r"ENV\[", "Environment variable", "", "", "", ""),
    ("injection", "csharp", "sink", r"Process\.Start", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "csharp", "sink", r"SqlCommand|ExecuteReader|ExecuteNonQuery|ExecuteScalar", "SQL Injection", "CWE-89", "", "", ""),
    ("injection", "csharp", "sink", r"BinaryFormatter|XmlSerializer\.Deserialize", "Insecure Deserialization", "CWE-502", "", "", ""),
    ("injection", "csharp", "sink", r"File\.Open|File\.ReadAllText|Path\.Combine", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "csharp", "source", r"Request\.(Query|Form|Headers|Cookies)", "ASP.NET request input", "", "", "", ""),
    ("injection", "csharp", "source", r"Environment\.GetEnvironmentVariable", "Environment variable", "", "", "", ""),
    ("injection", "c", "sink", r"^(system|popen|execl|execlp|execle|execv|execvp)$", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "c", "sink", r"^(strcpy|strcat|sprintf|gets|memcpy)$", "Buffer Overflow", "CWE-120", "", "", ""),
    ("injection", "c", "sink", r"^(fopen|open)$", "Path Traversal", "CWE-22", "", "", ""),
    ("injection", "c", "sink", r"^(malloc|free|realloc)$", "Memory Management (use-after-free / double-free candidates)", "CWE-416", "", "", ""),
    ("injection", "c", "source", r"^(getenv|argv)$", "Environment / CLI input", "", "", "", ""),
    ("injection", "c", "source", r"^(recv|read|fgets|scanf)$", "Network / stdin input", "", "", "", ""),
    ("injection", "cpp", "sink", r"^(system|popen|execl|execlp)$", "OS Command Injection", "CWE-78", "", "", ""),
    ("injection", "cpp", "sink", r"^(strcpy|strcat|sprintf|memcpy)$", "Buffer Overflow", "CWE-120", "", "", ""),
    ("injection", "cpp", "sink", r"^(new|delete)$", "Memory Management (use-after-free / double-free candidates)", "CWE-416", "", "", ""),
    ("injection", "cpp", "source", r"^(getenv|argv)$", "Environment / CLI input", "", "", "", ""),
    ("injection", "cpp", "source", r"^(recv|read)$", "Network input", "", "", "", ""),
    ("absence", "javascript", "trigger", r"\b(?:app|router)\.(?:get|post|put|patch|delete|all)\s*\(", "Express route registration", "", "", "route", ""),
    ("absence", "javascript", "trigger", r"\.(?:insertOne|insertMany|insert|updateOne|updateMany|update|replaceOne|deleteOne|deleteMany|remove|save|findOneAndUpdate|findOneAndDelete|findOneAndReplace|bulkWrite|create)\s*\(", "Database write", "", "", "db_write", ""),
    ("absence", "javascript", "trigger", r"\.(?:findOne|find|aggregate|countDocuments|distinct|findById)\s*\(|\$where", "Database read", "", "", "db_read", ""),
    ("absence", "javascript", "trigger", r"res\.(?:sendFile|download|attachment)\s*\(", "File send to client", "", "", "file_send", ""),
    ("absence", "javascript", "trigger", r"bcrypt\.(?:compare|hash)\s*\(|\.comparePassword\s*\(|\.setPassword\s*\(|jwt\.sign\s*\(", "Credential / token handling", "", "", "credential", ""),
    ("absence", "javascript", "guard", r"\b(?:requireAuth|isLoggedIn|isAuthenticated|ensureLoggedIn|ensureAuthenticated|checkAuth|needsAuth|requiresLogin|verifyToken|authRequired)\b|passport\.authenticate\s*\(|req\.isAuthenticated\s*\(\)", "Authentication middleware / check", "", "", "", "authentication"),
    ("absence", "javascript", "guard", r"\b(?:isAdmin|requireAdmin|ensureAdmin|hasRole|checkRole|requireRole|authorize|can|ability)\b|\.role\s*(?:===|!==|==|!=)|req\.user\.(?:isAdmin|role|admin|permissions)", "Role / privilege check", "", "", "", "authorization"),
    ("absence", "javascript", "guard", r"req\.user\.(?:_id|id)\s*(?:===|!==|==|!=)|\.(?:ownerId|owner|userId|createdBy|author)\s*(?:===|!==|==|!=)|\.equals\s*\(\s*req\.user|belongsTo\s*\(", "Ownership comparison", "", "", "", "ownership"),
    ("absence", "javascript", "guard", r"req\.session\.(?:userId|user|uid|passport)|req\.session\s*&&|if\s*\(\s*!?\s*req\.session\b|req\.session\.user\b", "Session validation", "", "", "", "session"),
    ("absence", "javascript", "guard", r"req\.check(?:Body|Params|Query)\s*\(|validationResult\s*\(|express-validator|\bcelebrate\s*\(|Joi\.|\.validate\s*\(|sanitize(?:Body|Param)?\s*\(", "Input validation guard", "", "", "", "validation"),
    ("absence", "typescript", "trigger", r"\b(?:app|router)\.(?:get|post|put|patch|delete|all)\s*\(", "Express route registration", "", "", "route", ""),
    ("absence", "typescript", "trigger", r"@(?:Get|Post|Put|Patch|Delete)\s*\(", "Controller route decorator", "", "", "route", ""),
    ("absence", "typescript", "trigger", r"\.(?:insert|update|delete|save|remove|softDelete|create)\s*\(|createQueryBuilder\s*\(|\.(?:findOne|find|findBy|findOneBy)\s*\(", "Repository read/write", "", "", "db_write", ""),
    ("absence", "typescript", "trigger", r"res\.(?:sendFile|download)\s*\(", "File send to client", "", "", "file_send", ""),
    ("absence", "typescript", "guard", r"@(?:UseGuards|Roles|Auth)\s*\(|\b(?:AuthGuard|JwtAuthGuard|RolesGuard)\b|passport\.authenticate\s*\(|req\.isAuthenticated\s*\(\)|\b(?:isAuthenticated|ensureAuthenticated|requireAuth)\b", "Authentication guard / decorator", "", "", "", "authentication"),
    ("absence", "typescript", "guard", r"\b(?:hasRole|checkRole|requireRole|isAdmin|authorize)\b|\.role\s*(?:===|!==)|@Roles\s*\(", "Role / privilege check", "", "", "", "authorization"),
    ("absence", "typescript", "guard", r"\.(?:ownerId|userId|owner|createdBy)\s*(?:===|!==)|\.equals\s*\(\s*(?:req\.)?user|user\.id\s*(?:===|!==)", "Ownership comparison", "", "", "", "ownership"),
    ("absence", "typescript", "guard", r"class-validator|\bvalidateOrReject\b|\bplainToClass\b|ValidationPipe|\.validate\s*\(", "Input validation guard", "", "", "", "validation"),
    ("absence", "python", "trigger", r"@(?:app|bp|blueprint|router)\.(?:route|get|post|put|patch|delete)\s*\(|add_url_rule\s*\(", "Flask/FastAPI route registration", "", "", "route", ""),
    ("absence", "python", "trigger", r"\.(?:execute|executemany|raw)\s*\(|session\.(?:add|delete|merge)\s*\(|\.objects\.(?:create|update|delete|get_or_create)|\.save\s*\(\)", "Database read/write", "", "", "db_write", ""),
    ("absence", "python", "trigger", r"send_file\s*\(|send_from_directory\s*\(|FileResponse\s*\(", "File send to client", "", "", "file_send", ""),
    ("absence", "python", "trigger", r"check_password_hash\s*\(|generate_password_hash\s*\(|\.set_password\s*\(|jwt\.encode\s*\(", "Credential / token handling", "", "", "credential", ""),
    ("absence", "python", "guard", r"@login_required|@jwt_required|current_user\.is_authenticated|request\.user\.is_authenticated|\blogin_required\b|Depends\s*\(\s*get_current_user", "Authentication decorator / check", "", "", "", "authentication"),
    ("absence", "python", "guard", r"@(?:admin_required|roles_required|permission_required)|current_user\.(?:is_admin|role|has_role)|\.has_perm\s*\(|is_staff|is_superuser", "Role / privilege check", "", "", "", "authorization"),
    ("absence", "python", "guard", r"\.(?:user_id|owner_id|created_by|author_id)\s*(?:==|!=)\s*(?:current_user|request\.user)|current_user\.id\s*(?:==|!=)", "Ownership comparison", "", "", "", "ownership"),
    ("absence", "python", "guard", r"""session\.get\s*\(\s*['"](?:user|user_id|uid)|['"]user_id['"]\s*in\s*session|if\s+not\s+session\b""", "Session validation", "", "", "", "session"),
    ("absence", "python", "guard", r"\.is_valid\s*\(\)|schema\.load\s*\(|pydantic|marshmallow|\bvalidate\s*\(|abort\s*\(\s*40[13]", "Input validation guard", "", "", "", "validation"),
    ("hygiene", "javascript", "check", r"""createHash\(\s*['"](md5|sha1)['"]|createCipher\(|['"](des|des-ede3|rc4|bf)['"]|algorithm\s*:\s*['"]HS?(none|None)['"]""", "Weak Cryptography", "CWE-327", "medium", "", ""),
    ("hygiene", "javascript", "check", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED|checkServerIdentity\s*:\s*\(\s*\)\s*=>|secure\s*:\s*false", "Improper Certificate / TLS Validation", "CWE-295", "high", "", ""),
    ("hygiene", "javascript", "check", r"""(?i)(api[_-]?key|secret|token|password|passwd|pwd|client[_-]?secret|private[_-]?key)\s*[:=]\s*['"][A-Za-z0-9/+_\-]{12,}['"]""", "Hardcoded Credential", "CWE-798", "high", "", ""),
    ("hygiene", "javascript", "check", r"""jwt\.sign\(|jsonwebtoken|algorithm\s*:\s*['"]none['"]|jwt\.verify\([^,]+,[^,)]+\)""", "Weak JWT Verification", "CWE-347", "medium", "", ""),
    ("hygiene", "javascript", "check", r"Math\.random\(\)", "Insecure Randomness (security context)", "CWE-330", "low", "", ""),
    ("hygiene", "javascript", "check", r"""cors\(\s*\)|origin\s*:\s*['"]\*['"]|Access-Control-Allow-Origin['"]\s*,\s*['"]\*""", "Overly Permissive CORS", "CWE-942", "medium", "", ""),
    ("hygiene", "javascript", "check", r"helmet\.contentSecurityPolicy\(\s*false|contentSecurityPolicy\s*:\s*false", "Content Security Policy Disabled", "CWE-1021", "low", "", ""),
    ("hygiene", "python", "check", r"hashlib\.(md5|sha1)\(|Crypto\.Cipher\.(DES|ARC4)|MD5|SHA1(?!\d)", "Weak Cryptography", "CWE-327", "medium", "", ""),
    ("hygiene", "python", "check", r"verify\s*=\s*False|ssl\._create_unverified_context|check_hostname\s*=\s*False|CERT_NONE", "Improper Certificate / TLS Validation", "CWE-295", "high", "", ""),
    ("hygiene", "python", "check", r"""(?i)(api_?key|secret|token|password|passwd|client_?secret|private_?key)\s*=\s*['"][A-Za-z0-9/+_\-]{12,}['"]""", "Hardcoded Credential", "CWE-798", "high", "", ""),
    ("hygiene", "python", "check", r"random\.(random|randint|choice|randrange)\(|random\.Random\(", "Insecure Randomness (security context)", "CWE-330", "low", "", ""),
    ("hygiene", "python", "check", r"DEBUG\s*=\s*True|app\.run\([^)]*debug\s*=\s*True", "Debug Mode Enabled", "CWE-489", "medium", "", ""),
    ("hygiene", "python", "check", r"jwt\.decode\([^)]*verify\s*=\s*False|options\s*=\s*\{[^}]*verify_signature[^}]*False", "Weak JWT Verification", "CWE-347", "medium", "", ""),
    ("hygiene", "java", "check", r'MessageDigest\.getInstance\(\s*"(MD5|SHA-1|SHA1)"|"(DES|RC4|Blowfish)"|Cipher\.getInstance\(\s*"[^"/]*/ECB', "Weak Cryptography", "CWE-327", "medium", "", ""),
    ("hygiene", "java", "check", r"TrustAllCerts|X509TrustManager|ALLOW_ALL_HOSTNAME_VERIFIER|setHostnameVerifier\(\s*\(\s*\)", "Improper Certificate / TLS Validation", "CWE-295", "high", "", ""),
    ("hygiene", "java", "check", r'(?i)(api_?key|secret|token|password|client_?secret)\s*=\s*"[A-Za-z0-9/+_\-]{12,}"', "Hardcoded Credential", "CWE-798", "high", "", ""),
    ("hygiene", "java", "check", r"new Random\(|Math\.random\(", "Insecure Randomness (security context)", "CWE-330", "low", "", ""),
    ("hygiene", "go", "check", r"md5\.New\(|sha1\.New\(|des\.NewCipher\(|rc4\.NewCipher\(", "Weak Cryptography", "CWE-327", "medium", "", ""),
    ("hygiene", "go", "check", r"InsecureSkipVerify\s*:\s*true", "Improper Certificate / TLS Validation", "CWE-295", "high", "", ""),
    ("hygiene", "go", "check", r'(?i)(api_?key|secret|token|password|client_?secret)\s*[:=]\s*"[A-Za-z0-9/+_\-]{12,}"', "Hardcoded Credential", "CWE-798", "high", "", ""),
    ("hygiene", "go", "check", r"math/rand|rand\.Intn\(|rand\.Int\(", "Insecure Randomness (security context)", "CWE-330", "low", "", ""),
)
# In the hygiene set, typescript has the rules of javascript.
ALIASES = {("hygiene", "typescript"): "javascript"}
