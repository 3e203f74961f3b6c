"""Risky functions of languages by kind of defect: the parameters from which the packs are built."""

from __future__ import annotations

#: kind -> (severity, weakness, message)
KINDS = {
    "code": ("critical", "CWE-95", "runs text as code"),
    "command": ("critical", "CWE-78", "runs an operating system command"),
    "query": ("critical", "CWE-89", "sends a query"),
    "load": ("critical", "CWE-502", "revives objects from bytes"),
    "file": ("high", "CWE-22", "opens a path"),
    "fetch": ("high", "CWE-918", "calls an address"),
    "markup": ("high", "CWE-79", "writes markup"),
    "redirect": ("medium", "CWE-601", "redirects"),
    "digest": ("medium", "CWE-327", "uses an outdated algorithm"),
    "random": ("medium", "CWE-338", "draws guessable numbers"),
    "memory": ("high", "CWE-120", "copies without a bound"),
    "log": ("low", "CWE-532", "writes to a log"),
    "xml": ("high", "CWE-611", "parses XML"),
    "exit": ("low", "CWE-382", "ends the process"),
    "temp": ("medium", "CWE-377", "makes a temporary file"),
    "debug": ("info", "CWE-489", "is left from debugging"),
}

#: language -> kind -> functions
APIS = {
    "python": {
        "code": "eval exec compile execfile runpy.run_path code.interact", "command": "os.system os.popen os.execvp os.spawnl subprocess.call subprocess.run subprocess.Popen subprocess.check_output commands.getoutput pty.spawn",
        "query": "cursor.execute cursor.executemany session.execute engine.execute connection.execute db.execute objects.raw", "load": "pickle.load pickle.loads cPickle.loads dill.loads shelve.open marshal.loads yaml.load yaml.unsafe_load jsonpickle.decode joblib.load torch.load",
        "file": "open io.open os.remove os.unlink os.rename shutil.rmtree shutil.copy send_file send_from_directory", "fetch": "requests.get requests.post requests.put requests.delete urllib.request.urlopen httpx.get aiohttp.request",
        "markup": "mark_safe Markup render_template_string format_html", "redirect": "redirect HttpResponseRedirect RedirectResponse", "digest": "hashlib.md5 hashlib.sha1 hashlib.new DES.new ARC4.new Blowfish.new",
        "random": "random.random random.randint random.choice random.randrange random.shuffle", "log": "print logger.info logger.debug logging.info logging.debug", "xml": "etree.parse etree.fromstring minidom.parse sax.parse",
        "exit": "os._exit sys.exit os.abort", "temp": "tempfile.mktemp os.tempnam os.tmpnam", "debug": "pdb.set_trace breakpoint ipdb.set_trace",
    },
    "javascript": {
        "code": "eval Function setTimeout setInterval vm.runInContext vm.runInNewContext vm.runInThisContext", "command": "child_process.exec child_process.execSync child_process.spawn child_process.execFile shell.exec execa",
        "query": "db.query connection.query pool.query sequelize.query knex.raw client.query", "load": "serialize.unserialize YAML.load v8.deserialize", "file": "fs.readFile fs.readFileSync fs.writeFile fs.writeFileSync fs.unlink fs.createReadStream fs.createWriteStream res.sendFile path.join",
        "fetch": "fetch axios.get axios.post axios.request http.get https.get request.get got", "markup": "document.write document.writeln insertAdjacentHTML res.send $.html", "redirect": "res.redirect window.open location.assign location.replace",
        "digest": "crypto.createHash crypto.createCipher md5 sha1", "random": "Math.random", "log": "console.log console.debug console.error console.warn", "xml": "parseXml libxmljs.parseXml xml2js.parseString", "exit": "process.exit process.abort", "debug": "alert console.trace console.table",
    },
    "java": {
        "code": "scriptEngine.eval GroovyShell.evaluate Class.forName Method.invoke parser.parseExpression", "command": "Runtime.getRuntime().exec ProcessBuilder processBuilder.start runtime.exec",
        "query": "statement.executeQuery statement.executeUpdate statement.execute createQuery createNativeQuery jdbcTemplate.query jdbcTemplate.update", "load": "readObject readUnshared XMLDecoder.readObject xstream.fromXML Yaml.load SerializationUtils.deserialize",
        "file": "FileInputStream FileOutputStream FileReader FileWriter Paths.get Files.readAllBytes Files.delete RandomAccessFile", "fetch": "openConnection openStream restTemplate.getForObject restTemplate.exchange httpClient.execute", "markup": "response.getWriter().write out.println getWriter().print",
        "redirect": "sendRedirect getRequestDispatcher", "digest": "MessageDigest.getInstance Cipher.getInstance KeyGenerator.getInstance DigestUtils.md5Hex DigestUtils.sha1Hex", "random": "Math.random Random.nextInt ThreadLocalRandom.current", "log": "System.out.println System.err.println printStackTrace log.info log.debug",
        "xml": "DocumentBuilderFactory.newInstance SAXParserFactory.newInstance XMLInputFactory.newInstance TransformerFactory.newInstance", "exit": "System.exit Runtime.getRuntime().halt", "temp": "File.createTempFile",
    },
    "go": {
        "command": "exec.Command exec.CommandContext syscall.Exec os.StartProcess", "query": "db.Query db.QueryRow db.Exec tx.Exec tx.Query db.Raw", "load": "gob.NewDecoder yaml.Unmarshal", "file": "os.Open os.OpenFile os.Create os.Remove os.RemoveAll ioutil.ReadFile os.ReadFile ioutil.WriteFile filepath.Join http.ServeFile",
        "fetch": "http.Get http.Post http.Head http.PostForm client.Get client.Do", "markup": "template.HTML template.JS template.URL fmt.Fprintf", "redirect": "http.Redirect", "digest": "md5.New md5.Sum sha1.New sha1.Sum des.NewCipher rc4.NewCipher",
        "random": "rand.Int rand.Intn rand.Float64 rand.Seed", "log": "fmt.Println fmt.Printf log.Println log.Printf", "exit": "os.Exit log.Fatal panic", "temp": "ioutil.TempFile ioutil.TempDir", "xml": "xml.Unmarshal xml.NewDecoder", "memory": "unsafe.Pointer reflect.SliceHeader",
    },
    "c": {
        "command": "system popen execl execlp execvp", "memory": "gets strcpy strcat sprintf vsprintf memcpy memmove bcopy alloca scanf sscanf fscanf wcscpy wcscat stpcpy realpath", "file": "fopen open freopen access chmod chown rename unlink", "random": "rand srand random drand48 lrand48",
        "temp": "tmpnam tempnam mktemp tmpfile", "log": "printf fprintf syslog vprintf", "digest": "MD5_Init SHA1_Init DES_set_key RC4_set_key EVP_md5 EVP_sha1", "exit": "abort exit _exit longjmp", "load": "dlopen dlsym",
    },
    "cpp": {
        "command": "std::system boost::process::system", "memory": "std::strcpy std::strcat std::sprintf std::memcpy std::copy reinterpret_cast const_cast std::gets", "file": "std::ifstream std::ofstream std::fstream std::remove std::rename fs::remove_all", "random": "std::rand std::srand std::random_shuffle",
        "temp": "std::tmpnam std::tmpfile", "log": "std::printf std::fprintf qDebug qWarning", "exit": "std::exit std::abort std::terminate std::quick_exit", "digest": "QCryptographicHash::hash", "load": "boost::archive::load",
    },
    "csharp": {
        "code": "CSharpScript.EvaluateAsync Assembly.Load Activator.CreateInstance Type.GetType", "command": "Process.Start ProcessStartInfo", "query": "SqlCommand ExecuteSqlRaw FromSqlRaw ExecuteReader ExecuteNonQuery ExecuteScalar", "load": "BinaryFormatter.Deserialize LosFormatter.Deserialize JsonConvert.DeserializeObject XmlSerializer.Deserialize NetDataContractSerializer.ReadObject",
        "file": "File.ReadAllText File.WriteAllText File.Open File.Delete Path.Combine StreamReader StreamWriter", "fetch": "WebRequest.Create client.GetAsync client.PostAsync WebClient.DownloadString", "markup": "Html.Raw Response.Write HtmlString", "redirect": "Redirect Response.Redirect RedirectPermanent",
        "digest": "MD5.Create SHA1.Create DES.Create TripleDES.Create RC2.Create", "random": "Random.Next", "log": "Console.WriteLine Debug.WriteLine Trace.WriteLine", "xml": "XmlDocument.Load XmlReader.Create XmlTextReader", "exit": "Environment.Exit Environment.FailFast", "temp": "Path.GetTempFileName",
    },
    "php": {
        "code": "eval assert create_function preg_replace call_user_func call_user_func_array", "command": "exec shell_exec system passthru popen proc_open pcntl_exec", "query": "mysql_query mysqli_query pg_query sqlite_query odbc_exec", "load": "unserialize yaml_parse igbinary_unserialize",
        "file": "include include_once require require_once fopen file_get_contents file_put_contents readfile unlink move_uploaded_file copy", "fetch": "curl_exec curl_init fsockopen get_headers", "markup": "echo print printf", "redirect": "header", "digest": "md5 sha1 crypt mcrypt_encrypt hash",
        "random": "rand mt_rand uniqid lcg_value", "log": "error_log var_dump print_r", "xml": "simplexml_load_string simplexml_load_file xml_parse", "exit": "die exit", "temp": "tempnam tmpfile", "debug": "phpinfo debug_backtrace debug_zval_refcount",
    },
    "ruby": {
        "code": "eval instance_eval class_eval module_eval binding.eval send public_send constantize", "command": "system exec spawn IO.popen Open3.capture3 Open3.popen3 Kernel.system", "query": "find_by_sql execute select_all where exec_query", "load": "Marshal.load YAML.load Oj.load PStore.new",
        "file": "File.open File.read File.write File.delete IO.read FileUtils.rm_rf send_file Dir.glob", "fetch": "Net::HTTP.get URI.open HTTParty.get RestClient.get Faraday.get", "markup": "raw html_safe render", "redirect": "redirect_to", "digest": "Digest::MD5.hexdigest Digest::SHA1.hexdigest OpenSSL::Cipher.new",
        "random": "rand Random.rand Kernel.rand", "log": "puts logger.info logger.debug Rails.logger.info", "xml": "Nokogiri::XML REXML::Document.new", "exit": "exit! abort exit", "temp": "Tempfile.new Dir.tmpdir", "debug": "binding.pry byebug debugger",
    },
    "kotlin": {
        "code": "engine.eval Class.forName", "command": "Runtime.getRuntime().exec ProcessBuilder", "query": "rawQuery execSQL createQuery createNativeQuery", "load": "readObject fromXML", "file": "File openFileOutput FileInputStream Paths.get", "fetch": "URL openConnection readText httpClient.get",
        "markup": "loadUrl loadData evaluateJavascript addJavascriptInterface", "digest": "MessageDigest.getInstance Cipher.getInstance", "random": "Random.nextInt Math.random", "log": "println Log.d Log.i Log.v", "exit": "exitProcess System.exit", "temp": "createTempFile", "redirect": "sendRedirect startActivity",
    },
    "swift": {
        "code": "evaluateJavaScript NSExpression", "command": "Process.launchedProcess NSTask.launch", "query": "sqlite3_exec sqlite3_prepare_v2", "load": "NSKeyedUnarchiver.unarchiveObject NSUnarchiver.unarchiveObject", "file": "FileManager.default.contents FileManager.default.removeItem",
        "fetch": "URLSession.shared.dataTask NSURLConnection.sendSynchronousRequest", "markup": "loadHTMLString", "digest": "CC_MD5 CC_SHA1 CCCrypt", "random": "arc4random rand random drand48", "log": "print NSLog debugPrint dump", "memory": "UnsafeMutablePointer unsafeBitCast withUnsafePointer memcpy", "exit": "fatalError exit abort", "redirect": "UIApplication.shared.open",
    },
    "rust": {
        "command": "Command::new process::Command::new", "query": "sqlx::query diesel::sql_query conn.execute client.query", "load": "serde_yaml::from_str bincode::deserialize rmp_serde::from_slice", "file": "File::open File::create fs::read fs::write fs::remove_file fs::remove_dir_all Path::new", "fetch": "reqwest::get ureq::get Client::new",
        "memory": "mem::transmute ptr::read ptr::write from_raw_parts get_unchecked mem::forget mem::uninitialized", "digest": "Md5::new Sha1::new md5::compute", "random": "rand::random thread_rng SmallRng::from_entropy", "log": "println! eprintln! dbg! print!", "exit": "panic! process::exit unwrap expect unreachable! todo! unimplemented!", "temp": "env::temp_dir",
    },
    "scala": {
        "code": "toolbox.eval engine.eval", "command": "Process Runtime.getRuntime.exec sys.process.Process", "query": "sql.executeQuery executeUpdate createStatement", "load": "readObject ObjectInputStream", "file": "Source.fromFile Files.delete FileWriter Paths.get", "fetch": "Source.fromURL ws.url Http",
        "markup": "Html raw", "digest": "MessageDigest.getInstance Cipher.getInstance", "random": "Random.nextInt Math.random", "log": "println printStackTrace logger.info", "exit": "sys.exit System.exit", "xml": "XML.loadString XML.loadFile", "redirect": "Redirect sendRedirect",
    },
    "bash": {
        "code": "eval source", "command": "bash sh xargs sudo nohup", "file": "rm chmod chown mv cp ln", "fetch": "curl wget nc telnet ftp scp", "temp": "mktemp", "log": "echo printf logger", "digest": "md5sum sha1sum", "random": "shuf", "query": "mysql psql sqlite3", "exit": "kill killall pkill reboot shutdown",
    },
    "sql": {
        "code": "EXECUTE sp_executesql EXEC", "command": "xp_cmdshell sys_exec sys_eval", "query": "OPENROWSET OPENQUERY OPENDATASOURCE", "file": "LOAD_FILE BULK_INSERT UTL_FILE.FOPEN pg_read_file lo_import", "fetch": "UTL_HTTP.REQUEST HTTPURITYPE dblink", "digest": "MD5 SHA1 HASHBYTES", "random": "RAND NEWID random", "exit": "SHUTDOWN pg_terminate_backend",
    },
    "dart": {
        "command": "Process.run Process.start Process.runSync", "query": "rawQuery rawInsert rawUpdate rawDelete", "load": "jsonDecode", "file": "File Directory File.fromUri", "fetch": "http.get http.post HttpClient Dio", "markup": "evaluateJavascript runJavascript loadUrl", "digest": "md5.convert sha1.convert", "random": "Random", "log": "print debugPrint log", "exit": "exit", "redirect": "launchUrl launch",
    },
    "lua": {
        "code": "loadstring load dofile loadfile setfenv", "command": "os.execute io.popen", "query": "conn:execute cur:execute db:query", "file": "io.open os.remove os.rename io.lines", "fetch": "http.request socket.connect", "random": "math.random math.randomseed", "log": "print io.write", "exit": "os.exit error", "temp": "os.tmpname", "markup": "ngx.say ngx.print", "redirect": "ngx.redirect", "digest": "md5.sumhexa ngx.md5",
    },
    "r": {
        "code": "eval parse source sys.source assign", "command": "system system2 shell pipe", "query": "dbGetQuery dbSendQuery dbExecute sqlQuery", "load": "readRDS load unserialize dget", "file": "file unlink file.remove file.copy read.table", "fetch": "download.file GET POST url", "random": "sample runif rnorm set.seed", "log": "print cat message", "exit": "quit q stop", "temp": "tempfile tempdir", "digest": "digest md5",
    },
    "haskell": {
        "code": "interpret unsafeInterpret", "command": "system readProcess callCommand rawSystem createProcess", "query": "query_ execute_ rawQuery rawExecute", "load": "read decode", "file": "readFile writeFile removeFile openFile", "fetch": "simpleHTTP httpLBS getResponse", "memory": "unsafePerformIO unsafeCoerce peek poke castPtr", "random": "randomIO randomRIO newStdGen", "log": "trace putStrLn print", "exit": "error undefined exitFailure", "digest": "md5 sha1",
    },
    "elixir": {
        "code": "Code.eval_string Code.eval_file EEx.eval_string apply", "command": "System.cmd System.shell :os.cmd Port.open", "query": "Ecto.Adapters.SQL.query Repo.query fragment", "load": ":erlang.binary_to_term", "file": "File.read File.write File.rm File.rm_rf File.open send_file", "fetch": "HTTPoison.get HTTPoison.post Req.get Tesla.get",
        "markup": "raw html", "redirect": "redirect", "digest": ":crypto.hash :crypto.md5", "random": ":rand.uniform Enum.random", "log": "IO.puts IO.inspect Logger.debug Logger.info", "exit": "System.halt exit", "memory": "String.to_atom binary_to_atom",
    },
    "perl": {
        "code": "eval do require", "command": "system exec qx open2 open3", "query": "prepare selectall_arrayref selectrow_array", "load": "thaw retrieve Storable::thaw YAML::Load", "file": "open opendir unlink rename chmod", "fetch": "LWP::Simple::get getstore mirror", "random": "rand srand", "log": "print printf warn", "exit": "die exit croak", "digest": "md5_hex sha1_hex md5", "temp": "tmpnam",
    },
    "groovy": {
        "code": "Eval.me evaluate GroovyShell", "command": "execute sh bat", "query": "sql.rows sql.execute sql.eachRow", "load": "readObject", "file": "File readFile writeFile deleteDir", "fetch": "URL httpRequest", "digest": "MessageDigest.getInstance", "random": "Random Math.random", "log": "println echo", "exit": "System.exit error",
    },
    "objectivec": {
        "code": "stringByEvaluatingJavaScriptFromString performSelector NSClassFromString", "command": "system popen", "query": "sqlite3_exec executeQuery executeUpdate", "load": "unarchiveObjectWithData unarchiveObjectWithFile", "file": "fopen contentsAtPath removeItemAtPath", "fetch": "dataWithContentsOfURL sendSynchronousRequest", "memory": "strcpy strcat sprintf memcpy gets", "digest": "CC_MD5 CC_SHA1", "random": "rand random srand", "log": "NSLog printf", "markup": "loadHTMLString", "exit": "abort exit",
    },
    "julia": {
        "code": "eval include_string Meta.parse include", "command": "run read pipeline", "query": "DBInterface.execute SQLite.execute", "load": "deserialize Serialization.deserialize", "file": "open rm cp mv write", "fetch": "download HTTP.get HTTP.post", "memory": "unsafe_load unsafe_store! unsafe_wrap ccall reinterpret", "random": "rand randn shuffle", "log": "println print @show", "exit": "exit quit", "digest": "md5 sha1", "temp": "mktemp tempname",
    },
    "cobol": {"command": "SYSTEM CBL_EXEC_RUN_UNIT", "query": "EXECUTE PREPARE", "file": "CBL_OPEN_FILE CBL_DELETE_FILE CBL_READ_FILE", "random": "RANDOM", "exit": "ABEND"},
}
