"""Small source files for tables that hold no code: every part becomes a file, by turns vulnerable and guarded.

A sample is (extension, lines, what a scan is to find as (family, line from 1)); a part's file has a few comment lines before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.sources.tables import spread, table

SAMPLES: tuple[tuple[str, str, tuple[tuple[str, int], ...]], ...] = (
    ("js", "const a = 1;\napp.post('/pay', pay);\n", (("csrf", 2),)),
    ("js", "app.use(csurf());\napp.post('/pay', pay);\n", ()),
    ("js", "// no csurf here\nrouter\n  .delete(\n'/x', h);\n", (("csrf", 2),)),
    ("py", "@app.route('/x',\n  methods=['GET', 'POST'])\ndef f():\n    pass\n", (("csrf", 1),)),
    ("java", "class A {\n  @PostMapping(\"/a\")\n  void a() {}\n}\n", (("csrf", 2),)),
    ("py", "env.from_string(request.args['t'])\nenv.from_string('fixed')\n", (("template-injection", 1),)),
    ("js", "/* ejs.render(req.body.t) */\nejs.render(req.body.t);\n", (("template-injection", 2),)),
    ("py", "cur.execute(f\"select {x}\")\ncur.execute(\"select %s\", (x,))\n", (("sql-injection", 1),)),
    ("js", "db.query(\n  `select ${id}`);\ndb.query('select ?', [id]);\n", (("sql-injection", 1),)),
    ("java", "st.executeQuery(\"select a where b=\" + b);\nst.executeQuery(\"select 1\");\n", (("sql-injection", 1),)),
    ("py", "os.system('ls ' + name)\nsubprocess.run(['ls', name])\n", (("command-injection", 1),)),
    ("js", "exec(`ls ${dir}`);\nexec('ls');\n", (("command-injection", 1),)),
    ("js", "eval(req.body.code);\neval('1');\n", (("code-injection", 1),)),
    ("js", "el.innerHTML = name;\nel.innerHTML = '<b>';\n", (("xss", 1),)),
    ("js", "const x = DOMPurify.clean(name);\nel.innerHTML = x;\n", ()),
    ("js", "fs.readFile(req.query.f, cb);\n\n\n\n\n\n\nfs.readFile(basename(req.query.f), cb);\n", (("path-traversal", 1),)),
    ("py", "open(request.args['f'])\n", (("path-traversal", 1),)),
    ("js", "fetch(req.query.url);\n", (("ssrf", 1),)),
    ("py", "if host in allow_list:\n    requests.get(request.args['u'])\n", ()),
    ("py", "requests.get(request.args['u'], verify=False)\n", (("ssrf", 1), ("tls-unchecked", 1))),
    ("js", "res.redirect(req.query.next);\n", (("open-redirect", 1),)),
    ("js", "if (n.startsWith('/'))\n  res.redirect(req.query.next);\n", ()),
    ("py", "from lxml import etree\netree.parse(f)\n", (("xxe", 2),)),
    ("java", "DocumentBuilderFactory.newInstance();\nf.setFeature(\"x/disallow-doctype-decl\", true);\n", ()),
    ("py", "pickle.loads(data)\nyaml.load(s, Loader=SafeLoader)\nyaml.load(s)\n", (("deserialization", 1), ("deserialization", 3))),
    ("php", "<?php\n# unserialize($_GET['a']);\nunserialize($_POST['a']);\n", (("deserialization", 3),)),
    ("java", "new ObjectInputStream(in);\n", (("deserialization", 1),)),
    ("py", "hashlib.md5(x)\nhashlib.sha256(x)\n", (("weak-hash", 1),)),
    ("js", "const resetToken = Math.random();\nconst jitter = Math.random();\n", (("weak-random", 1),)),
    ("go", "apiKey := \"A1b2C3d4E5f6G7h8\"\napi_key := \"placeholder-value-1\"\n", (("hardcoded-secret", 1),)),
    ("js", "User.create(req.body);\nUser.create({name: n});\n", (("mass-assignment", 1),)),
    ("py", "User(**request.json)\n", (("mass-assignment", 1),)),
    ("js", "_.merge(conf, req.body);\n", (("prototype-pollution", 1),)),
    ("py", "jwt.decode(t, algorithms=['none'])\n", (("unverified-token", 1),)),
    ("go", "cfg := &tls.Config{InsecureSkipVerify: true}\n", (("tls-unchecked", 1),)),
    ("js", "res.cookie('a', v);\n\n\n\n\nres.cookie('b', v, {\n  secure: true });\n", (("cookie-flags", 1),)),
    ("py", "conn.search_s(base, scope, '(uid=' + uid + ')')\n", (("ldap-injection", 1),)),
    ("py", "tree.xpath('//user[name=' + n + ']')\ntree.xpath('//user')\n", (("xpath-injection", 1),)),
    ("js", "users.findOne({ name: req.body.name });\nusers.findOne({ name: String(n) });\n", (("nosql-injection", 1),)),
    ("py", "logging.info(user, password)\nprint('password')\n", (("secret-in-log", 1),)),
    ("py", "z.extractall(out)\n", (("zip-slip", 1),)),
    ("py", "z.extractall(out, filter='data')\n", ()),
    ("c", "void f(char *s) {\n  strcpy(b, s);\n  strncpy(b, s, 9);\n  // gets(b);\n}\n", (("buffer-overflow", 2),)),
    ("js", "res.setHeader('X-A', req.query.a);\n", (("response-splitting", 1),)),
    ("js", "const limit = rateLimit();\nserver.post('/login', jwt.verify, h);\n", ()),
    ("js", "server.post('/login', h);\n", (("csrf", 1), ("no-rate-limit", 1))),
    ("js", "const u = 'https://' + req.headers.host;\n", (("host-header", 1),)),
    ("py", "app.run(debug=True)\n", (("debug-mode", 1),)),
    ("yaml", "apiVersion: v1\nkind: Pod\nspec:\n  privileged: true # needed\n  # hostNetwork: true\n", (("privileged-container", 4),)),
    ("tf", "resource \"sg\" \"a\" {\n  cidr_blocks = [\"0.0.0.0/0\"]\n}\n", (("open-network", 2),)),
    ("rb", "=begin\npost '/x'\n=end\nputs 1 # done\n", ()),
    ("js", "\"unclosed\nfetch(req.query.url); // later\n'//' + x;\n", (("ssrf", 2),)),
)


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content, part, and turn (the number of the sample) of a file for each part."""
    marks = {"py": "#", "rb": "#", "yaml": "#", "php": "//"}
    rows = [(k, ext, body, marks.get(ext, "//")) for k, (ext, body, _) in enumerate(SAMPLES)]
    samples = F.broadcast(spark.createDataFrame(rows, "turn long, ext string, body string, mark string"))
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").withColumn("turn", F.col("p_partkey") % len(SAMPLES))
    head = F.repeat(F.concat_ws(" ", "mark", "p_name", F.lit("\n")), (F.col("p_size") % 7).cast("int"))
    path = F.concat(F.lit("app/m"), F.col("p_size") % 10, F.lit("/f"), F.col("p_partkey"), F.lit("."), F.col("ext"))
    return parts.join(samples, "turn").select(path.alias("path"), F.concat(head, F.col("body")).alias("content"), F.col("p_partkey").alias("part"), "turn")


#: The same findings as SQL: what each sample is to give, not what is in it.
EXPECTED = ", ".join(f"({k}, '{ext}', '{family}', {line})" for k, (ext, _, found) in enumerate(SAMPLES) for family, line in found)
FOUND_SQL = f"""(select 'app/m' || (p_size % 10) || '/f' || p_partkey || '.' || ext as path, cast(p_size % 7 + line as int) as line, family, p_partkey as part
  from part join (values {EXPECTED}) v(turn, ext, family, line) on p_partkey % {len(SAMPLES)} = turn)"""
PATHS_SQL = f"""(select 'app/m' || (p_size % 10) || '/f' || p_partkey || '.' || ext as path, p_partkey as part, turn, ext
  from part join (values {', '.join(f"({k}, '{ext}')" for k, (ext, _, _) in enumerate(SAMPLES))}) v(turn, ext) on p_partkey % {len(SAMPLES)} = turn)"""
