"""Labelled residue exemplars, by kind and language. All of this module is fixed values: phrases, not logic."""

from __future__ import annotations

#: Delimiters of template languages; what stands between them is a name (optionally with filters or quotes).
DELIMITERS = [
    ("{{{", "}}}"), ("{{", "}}"), ("{%", "%}"), ("<%=", "%>"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("%(", ")s"), ("%(", ")d"), ("*|", "|*"), ("%%", "%%"),
    ("[[", "]]"), ("@@", "@@"), ("##", "##"), ("__", "__"), ("<!--", "-->"), ("&lt;!--", "--&gt;"), ("&lt;%", "%&gt;"), ("{$", "}"), ("~~", "~~"), ("^^", "^^"), ("||", "||"), ("<<", ">>"), ("&lt;&lt;", "&gt;&gt;"), ("{#", "#}"), ("<?", "?>"),
]
#: Delimiters that count only around a name in capitals (or one joined by underscores), as other uses are common.
CAPITAL_DELIMITERS = [("[", "]"), ("<", ">"), ("&lt;", "&gt;"), ("«", "»"), ("{", "}"), ("$", "$"), ("%", "%"), ("XXX-", "-XXX"), ("{", "}")]

PLACEHOLDER = [
    "[insert]", "[insert name here]", "[insert headline]", "[insert quote here]", "[insert summary]", "[add source]", "[TODO: add source]", "[TODO]", "[TBD]", "[to be completed]", "[to come]", "[your name here]", "[your text here]", "[placeholder]", "[placeholder text]", "[image here]", "[caption goes here]", "[fill in]", "[enter title]",
    "(headline TBD)", "(summary TBD)", "(date TBC)", "(date to be confirmed)", "FIXME: write intro", "TODO: write the intro", "TK TK", "[object Object]", "undefined undefined", "NaN NaN",
    "[titre à compléter]", "[à compléter]", "[insérer le titre]", "[résumé à venir]", "[texte à venir]", "[Titel einfügen]", "[hier einfügen]", "[Name einsetzen]", "[Text folgt]", "[Zitat ergänzen]", "[bitte ergänzen]",
    "[insertar título]", "[título pendiente]", "[por completar]", "[completar aquí]", "[nombre aquí]", "[inserir título]", "[a preencher]", "[título a definir]", "[preencher aqui]",
    "【此处填写摘要】", "【此处填写标题】", "【此处插入图片】", "【请填写作者】", "【待补充】", "【标题待定】", "【在此输入正文】", "［此处填写］", "【ここにタイトルを入力】", "【要約をここに記入】", "【未記入】", "【本文をここに挿入】",
]

FILLER = [
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
    "Ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur",
    "Excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae nullam quis ligula vitae porta mattis tempora ornatus urbana talis sedula",
    "loremis ipsum dolor amet elitum magnis aliquo vestra tempora nullam cumque itaque porta mattis quam fringo semperis talis ornatus urbana sedula dolent vitae ligula",
    "This is placeholder text. Replace it before publishing.", "Sample paragraph. Replace this text with your own copy before publishing.", "Replace this paragraph with your own text.", "Your headline here", "Your subheading here", "Your story here", "Your text here", "Your content goes here", "Click to edit this text", "Add your text here", "Type something here", "Enter your content", "Insert body text here", "Sample text sample text", "Dummy text, please replace.", "Text goes here. Text goes here.", "Body copy to come. Body copy to come.", "Copy to follow.", "Content coming soon.", "This is where the intro goes. Keep it to two sentences.", "This is where the body goes.", "Write your paragraph here.", "Test test test", "asdf asdf asdf", "blah blah blah",
    "The quick brown fox jumps over the lazy dog",
    "Blindtext, bitte ersetzen.", "Hier steht Blindtext.", "Dies ist ein Platzhaltertext.", "Text folgt in Kürze.", "Ihr Text hier", "Beispieltext, bitte ersetzen", "Hier steht später der Artikel.",
    "Texte de remplissage à remplacer.", "Faux texte, à remplacer.", "Votre texte ici", "Votre titre ici", "Texte à venir. Texte à venir.", "Contenu à venir.", "Ceci est un texte provisoire.",
    "Texto de relleno, sustituir.", "Texto de ejemplo, sustituir antes de publicar.", "Su texto aquí", "Tu texto aquí", "Texto pendiente. Texto pendiente.", "Aquí va el texto del artículo.", "Contenido próximamente.",
    "Texto provisório, substituir.", "Texto de exemplo, substituir.", "Seu texto aqui", "Conteúdo em breve.", "Aqui vai o texto do artigo.",
    "正文待补充。", "此处为占位文字。", "占位文本，请替换。", "在此输入正文。", "内容即将上线。", "示例文本示例文本", "测试测试测试", "正文内容正文内容",
    "ここに本文を入力してください。", "ダミーテキストです。", "本文は後日追加します。", "仮の文章です。差し替えてください。", "サンプルテキスト",
]

ERROR = [
    "404 Not Found", "Page not found", "Not Found", "Error 404", "410 Gone", "Gone", "403 Forbidden", "Forbidden", "401 Unauthorized", "400 Bad Request", "500 Internal Server Error", "Internal Server Error", "502 Bad Gateway", "Bad Gateway", "503 Service Unavailable", "Service Unavailable", "504 Gateway Timeout", "Gateway Timeout", "429 Too Many Requests", "Too Many Requests",
    "nginx", "gateway", "nginx gateway", "nginx-like gateway", "cloud proxy error", "Apache server at port 80", "request id 0", "request 0", "Reference: 0", "Ray ID 0", "Incident number 0", "Error code: 0", "Error reference 0",
    "The page you asked for has gone or was never here.", "The page you requested could not be found.", "The requested URL was not found on this server.", "We looked everywhere and could not find that story.", "Oops! We could not find that page.", "Sorry, this page does not exist.", "This page has moved or been deleted.", "Go back to the front page", "Return to the home page", "Back to homepage", "This link has expired or the author has taken the post down.", "This article is no longer available.", "This content has been removed.",
    "Sorry, something broke on our side. Please try again in a few minutes. (ref 0)", "Something went wrong. Please try again later.", "An unexpected error occurred.", "Our servers are resting for planned maintenance. ETA 0 minutes.", "The site is down for scheduled maintenance. We will be back soon.", "The service is temporarily unavailable. Please try again later.", "The server is overloaded.", "upstream connect failure, reset before headers. reason: overflow", "upstream connect error or disconnect/reset before headers", "no healthy upstream", "connection timed out", "Database connection failed", "Error establishing a database connection", "Too many requests from your network. Slow down and come back later.", "You have been rate limited.",
    "Traceback (most recent call last):", "File \"/srv/render.py\", line 0, in page", "KeyError: 'story_0'", "TypeError: cannot read properties of undefined", "NullPointerException at line 0", "Fatal error: Uncaught exception in file on line 0", "Exception in thread main", "template rendering failed",
    "Seite nicht gefunden", "Fehler 404: Die gewünschte Seite wurde nicht gefunden.", "Die angeforderte Seite existiert nicht.", "Dieser Inhalt ist nicht mehr verfügbar.", "Der Dienst ist vorübergehend nicht erreichbar. Bitte versuchen Sie es in 0 Minuten noch einmal. 0", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Wartungsarbeiten: Wir sind bald zurück.", "Zu viele Anfragen.",
    "Page introuvable", "Erreur 404 : cette page est introuvable.", "La page demandée n’existe pas ou a été supprimée.", "Le service est momentanément indisponible, réessayez dans 0 minutes. (0)", "Une erreur est survenue. Veuillez réessayer plus tard.", "Site en maintenance.", "Ce contenu n’est plus disponible.", "Trop de requêtes.",
    "Página no encontrada", "Error 404: no encontramos la página que buscas.", "La página solicitada no existe.", "El servicio no está disponible por ahora. Inténtalo en 0 minutos. 0", "Se ha producido un error. Inténtelo de nuevo más tarde.", "Sitio en mantenimiento.", "Este contenido ya no está disponible.", "Demasiadas solicitudes.",
    "Página não encontrada", "Erro 404: não encontramos a página que você procura.", "A página solicitada não existe.", "O serviço está indisponível no momento. Tente novamente em 0 minutos. 0", "Ocorreu um erro. Tente novamente mais tarde.", "Site em manutenção.", "Este conteúdo não está mais disponível.",
    "页面不存在", "您访问的内容可能已被删除。", "404 页面未找到", "抱歉，您访问的页面不存在。", "服务器开小差了，请稍后再试（编号 0）", "服务暂时不可用，请稍后重试。", "系统维护中，请稍后访问。", "请求过于频繁，请稍后再试。", "该内容已下架。", "返回首页",
    "ページが見つかりません", "お探しのページは見つかりませんでした。", "404 ページが存在しません", "サーバーエラーが発生しました。しばらくしてからもう一度お試しください。", "ただいまメンテナンス中です。", "この記事は削除されました。", "ただいまサービスをご利用いただけません。0分後にもう一度お試しください。",
]

GATE = [
    "Please enable JavaScript to read this page.", "JavaScript is required to view this page.", "JavaScript is not available.", "We have detected that it is disabled in this browser. Ref 0", "You need to enable JavaScript to run this app.", "This app needs scripts to run. Turn them on in your browser settings and reload.", "You have scripting switched off, so the article cannot be shown here.", "If nothing appears, allow scripts and refresh.", "Loading… Loading…", "Loading, please wait", "Please turn on cookies and reload the page.", "Your browser is not supported.",
    "Checking that you are not a robot…", "Checking your browser before accessing the site.", "Verify you are human", "This takes about 0 seconds. Ray 0", "One more step: complete the puzzle below to prove you are human.", "Please complete the security check to continue.", "Complete the captcha to proceed.", "Just a moment…", "Unusual traffic from your network",
    "Access to this resource was refused. Your address has been noted as 0.", "Access denied. You do not have permission to view this page.", "You must be a subscriber to see this page. Session 0 not recognised.", "You must be logged in to view this page.", "Please sign in to continue reading.", "Subscribe to read the full story.", "This content is for members only.", "This content is not available in your region.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "JavaScript ist deaktiviert.", "Wir prüfen, ob Sie ein Mensch sind. Vorgang 0", "Bitte bestätigen Sie, dass Sie kein Roboter sind.", "Zugriff verweigert.", "Bitte melden Sie sich an, um diesen Artikel zu lesen.", "Dieser Artikel ist nur für Abonnenten.",
    "Activez JavaScript pour afficher cette page.", "Veuillez activer JavaScript dans votre navigateur.", "Vérification en cours, merci de patienter 0 secondes.", "Confirmez que vous n’êtes pas un robot.", "Accès refusé.", "Connectez-vous pour lire la suite.", "Article réservé aux abonnés.",
    "Activa JavaScript para ver esta página.", "Habilite JavaScript en su navegador para continuar.", "Comprobando que no eres un robot. 0", "Verifica que eres humano.", "Acceso denegado.", "Inicia sesión para seguir leyendo.", "Contenido exclusivo para suscriptores.",
    "Ative o JavaScript para ver esta página.", "Habilite o JavaScript no seu navegador.", "Verificando se você não é um robô. 0", "Acesso negado.", "Faça login para continuar lendo.", "Conteúdo exclusivo para assinantes.",
    "请启用 JavaScript 后继续浏览。", "加载中，请允许脚本运行", "您的浏览器未启用脚本。", "正在验证您是否为真人，请稍候…… 0", "请完成验证后继续访问。", "您没有权限查看此内容。", "请登录后查看全文。", "访问被拒绝。",
    "このページを表示するには JavaScript を有効にしてください。", "スクリプトを有効にしてから再読み込みしてください。", "ロボットでないことを確認しています。0", "アクセスが拒否されました。", "続きを読むにはログインしてください。", "会員限定の記事です。", "読み込み中です。スクリプトを許可してください。",
]

EXEMPLARS: list[tuple[str, str]] = [(k, t) for k, texts in (("placeholder", PLACEHOLDER), ("filler", FILLER), ("error", ERROR), ("gate", GATE)) for t in texts]
