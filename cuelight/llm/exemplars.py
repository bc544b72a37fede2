"""Labelled exemplars of residue: unfilled templates, filler text, error pages, notices that scripts are needed.

They are written from what is publicly known: the reason phrases of HTTP, the standard filler passage and the treatise that it
was cut from, messages of common servers, browsers, frameworks and players, hints of common forms and slides; not from the
tables. ``0`` stands for any number.
"""

from __future__ import annotations

from http import HTTPStatus

#: The treatise (De finibus 1.10.32-33) and the standard passage made of it, whose words filler is made of.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad
minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit
in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui
officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae
ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit
aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt neque porro quisquam
est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et
dolore magnam aliquam quaerat voluptatem ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit laboriosam
nisi ut aliquid ex ea commodi consequatur quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae
consequatur vel illum qui dolorem eum fugiat quo voluptas nulla pariatur
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores
et quas molestias excepturi sint occaecati cupiditate non provident similique sunt in culpa qui officia deserunt mollitia animi id
est laborum et dolorum fuga et harum quidem rerum facilis est et expedita distinctio nam libero tempore cum soluta nobis est eligendi
optio cumque nihil impedit quo minus id quod maxime placeat facere possimus omnis voluptas assumenda est omnis dolor repellendus
temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et
molestiae non recusandae itaque earum rerum hic tenetur a sapiente delectus
"""

#: Words that are typed again and again to fill a place.
UNITS = "テスト テキスト サンプル ダミー 文字 ほげ ふが ぴよ 測试 测试 示例 文字 테스트 텍스트 test text sample dummy blah bla foo xxx asdf".split()

#: The syllabary and rows of keys as they are typed to fill a place, and the names that stand for anything.
ROWS = ["あいうえおかきくけこ", "いろはにほへと", "アイウエオカキクケコ", "가나다라마바사", "abcdefg", "abc def ghi", "qwerty", "asdf jkl", "asdfghjkl", "foo bar baz", "hoge fuga piyo", "一二三四五六七八九十"]

TEMPLATE = """
ここにテキストを入力してください|ここに本文を入れてください|ここに文章を入力|ここに字幕を入力してください|テキストを入力してください|文字を入力してください|文字を入力|タイトルを入力|本文を入力|本文が入ります|テキストが入ります
ここに説明文が入ります|ここにテキストが入ります|字幕が入ります|この文章はダミーです|文字の大きさ、量、字間、行間等を確認するために入れています|ダミーテキスト|これはダミーの文章です|サンプルテキスト|サンプル文章です
これはサンプルの文章です|これは見本です|仮の文章です|仮テキスト|差し替えてください|後で差し替えます|未翻訳|未入力|未定|○さん|○様|○株式会社|○(氏名)
Insert text here|Insert your text here|Your text here|Your text goes here|Text goes here|Type your text here|Type something here|Type here|Enter text here|Enter your text|Click to add text|Click to add title|Add your text here
Add caption here|Caption goes here|Title goes here|Content goes here|Subtitle goes here|Placeholder text|Text placeholder|Sample text|Dummy text|This is sample text|This is placeholder text|Replace this text|Replace me|Text to be added
Text to follow|Text to come|Translation pending|Content pending|To be determined|To be announced|TODO fill in|TODO translate|TBD|TBA|FIXME
Platzhaltertext|Platzhalter für Text|Blindtext|Mustertext|Beispieltext|Hier steht Ihr Text|Hier steht der Text|Text hier eingeben|Text hier einfügen|Bitte Text eingeben|Dies ist ein Blindtext|Titel durch Klicken hinzufügen|Geben Sie Ihren Text ein
Texte d'exemple|Exemple de texte|Faux texte|Texte provisoire|Texte de remplacement|Texte à remplacer|Texte à insérer|Votre texte ici|Saisissez votre texte ici|Insérer le texte ici|Ajouter du texte ici|Cliquez pour ajouter un titre
Texto de ejemplo|Texto de relleno|Texto de muestra|Texto provisional|Su texto aquí|Escriba su texto aquí|Inserte el texto aquí|Introduzca el texto|Haga clic para agregar título
请在此输入文字|在此处输入内容|请输入内容|此处填写|此处填写内容|此处输入字幕|单击此处添加标题|点击添加文本|单击以编辑标题|示例文本|示例文字|占位文字|占位文本|样例文本
여기에 텍스트를 입력하세요|여기에 내용을 입력하세요|여기에 자막을 입력|내용을 입력하세요|제목을 입력하십시오|텍스트를 입력하십시오|예시 텍스트|샘플 텍스트|임시 텍스트|임시 문구입니다
ข้อความตัวอย่าง|พิมพ์ข้อความที่นี่|ใส่ข้อความที่นี่|यहाँ पाठ लिखें|यहां टेक्स्ट दर्ज करें|नमूना पाठ|नमूना टेक्स्ट
せりふをここに入力|セリフをここに入力|台詞をここに入力|せりふをここへ|ここにせりふを書く|ここにセリフが入ります|ここに台詞が入ります|訳文をここに入力|翻訳待ち|翻訳中です|翻訳未完了|未訳です|訳文未定|原稿待ち|原稿未着|字幕準備中|字幕未作成|字幕作成中|後で入力|後日記入|後ほど追記します|追って記入
仮字幕|仮題|本文未入力|内容未入力|要差し替え|差し替え予定|サンプル字幕|見出しを入力|コメントを入力してください|説明を入力してください|メッセージを入力してください|クリックして入力|クリックしてテキストを追加|クリックしてタイトルを入力|ダブルタップして編集|ダブルクリックして編集|ここへ文字を入れる
Awaiting translation|Not yet translated|Untranslated text|Translation goes here|Translation missing|Missing translation|Dialogue goes here|Insert dialogue here|Insert caption here|Insert subtitle here|Enter caption here|Enter subtitle here|Enter description here|Add description here|Write something here|Put your text here|Caption pending
Transcript pending|Transcription in progress|Draft text, do not publish|For position only|Copy to come|Copy goes here|Body text goes here|Headline goes here|Insert copy here|Filler text|Temporary text|Test caption|Test subtitle|Example text|Example subtitle|Default text|Double click to edit|Click to edit text|Tap to edit text|Click to add subtitle
Edit this text|Delete this text and add your own|To be filled in|Fill in later|Details to follow
Hier Text eingeben|Text folgt|Übersetzung folgt|Übersetzung ausstehend|Untertitel hier einfügen|Untertitel folgt|Hier Untertitel eingeben|Dialog hier einfügen|Text wird nachgereicht|Wird noch ergänzt|Inhalt folgt|Fülltext|Überschrift hier eingeben|Text ersetzen|Titel eingeben|Klicken Sie hier, um Text einzugeben
Texte à venir|Traduction à venir|Traduction en attente|Texte non traduit|Entrez votre texte ici|Tapez votre texte ici|Écrivez votre texte ici|Contenu à venir|Texte à compléter|Texte à remplir|Texte factice|Dialogue à insérer|Cliquez ici pour saisir du texte|Titre à insérer|Remplacez ce texte
Texto pendiente|Traducción pendiente|Pendiente de traducción|Texto sin traducir|Inserte el subtítulo aquí|Ingrese su texto aquí|Ingrese el texto|Añada su texto aquí|Contenido pendiente|Texto por completar|Texto por definir|Inserte el diálogo aquí|Haga clic para agregar texto|Haga clic aquí para escribir texto|Reemplace este texto|Texto ficticio
待翻译|等待翻译|尚未翻译|未翻译|翻译待补|字幕待补|字幕待添加|台词待补|在此输入台词|此处输入台词|请输入字幕|请输入标题|请输入文字|请输入文本|内容待补充|此处待填写|文本待定|在此处添加文字|在此添加标题|双击此处编辑|双击编辑文字|请替换为您的文字|替换此文本|测试文本|测试字幕|单击此处添加文本|此处为正文
번역 대기 중|번역 예정|미번역|번역되지 않음|자막 준비 중|자막을 입력하세요|대사를 입력하세요|여기에 대사를 입력|내용 추가 예정|추후 입력|추후 작성 예정|텍스트를 입력하세요|제목을 입력하세요|설명을 입력하세요|여기에 입력하세요|클릭하여 제목 추가|더미 텍스트|테스트 자막|예시 문구|문구를 입력하세요
รอการแปล|ยังไม่ได้แปล|ใส่คำบรรยายที่นี่|พิมพ์คำบรรยายที่นี่|ใส่ข้อความตรงนี้|กรอกข้อความที่นี่|เพิ่มข้อความที่นี่|คลิกเพื่อเพิ่มข้อความ|คลิกเพื่อเพิ่มชื่อเรื่อง|ข้อความทดสอบ|ข้อความจำลอง|ใส่บทพูดที่นี่
अनुवाद लंबित है|अनुवाद शेष है|अभी अनुवाद नहीं हुआ|यहाँ संवाद लिखें|यहाँ उपशीर्षक लिखें|अपना टेक्स्ट यहाँ लिखें|यहाँ टाइप करें|शीर्षक यहाँ लिखें|शीर्षक जोड़ने के लिए क्लिक करें|उदाहरण पाठ|परीक्षण पाठ
"""

ERROR = """
The page you are looking for cannot be found|The page you requested could not be found|The page you were looking for doesn't exist|The page may have been moved or deleted
The requested URL was not found on this server|Page not found|Oops, that page can't be found|Oops, this page does not exist|You may have mistyped the address|The link you followed may be broken
This page isn't available|This page isn't working|This site can't be reached|This webpage is not available|The server is not responding|The server took too long to respond
The server encountered an internal error and was unable to complete your request|The server is temporarily unable to service your request|Internal server error|Server error 0|Error 0 on the server|Error code 0
You don't have permission to access this resource|You do not have permission to view this page|Access denied|Access to this page has been denied|Permission denied
Something went wrong|Something went wrong, please try again later|Something went wrong on our end|We're sorry, but something went wrong|Whoops, looks like something went wrong|An error occurred, please try again later|An unexpected error has occurred
An unknown error occurred while loading the page|Failed to load resource|Failed to load captions|Could not load subtitles|Unable to load the video|Loading failed, reload the page|Please reload the page|Please refresh the page and try again
The connection was reset|Connection reset by peer|The connection has timed out|Connection timed out|Connection refused|Network error, check your internet connection|Upstream request timeout|Bad gateway, invalid response from the upstream server
Your session has expired, please log in again|Session timed out, sign in again|You have been signed out|Please sign in to continue
This video is unavailable|This video is no longer available|This video is not available in your country|This content is not available in your region|This video has been removed by the uploader|This content is currently unavailable
The site is down for maintenance|We are down for scheduled maintenance|We'll be back soon|Too many requests, try again later|Rate limit exceeded|Error establishing a database connection|Application error, a client-side exception has occurred
Uncaught TypeError, undefined is not a function|Cannot read properties of undefined|NullPointerException|Traceback most recent call last|Fatal error, uncaught exception|Segmentation fault core dumped|object Object undefined|undefined null NaN
お探しのページは見つかりませんでした|お探しのページが見つかりません|ページが見つかりません|ページが存在しません|指定されたページは存在しません|お探しのページは削除されたか移動した可能性があります|お探しのコンテンツは削除された可能性があります|お探しの動画は見つかりません
エラーが発生しました|エラー0が発生しました|予期しないエラーが発生しました|通信エラーが発生しました|サーバーエラーが発生しました|内部サーバーエラー|もう一度お試しください|しばらくしてからもう一度お試しください|時間をおいて再度お試しください|時間をおいて再度アクセスしてください
アクセスが集中しています|アクセスが集中しているためページを表示できません|サーバーが混み合っています|サーバーに接続できません|サーバーが応答していません|接続がタイムアウトしました|接続が切断されました|ページを再読み込みしてください|読み込みに失敗しました
ただいまメンテナンス中です|システムメンテナンス中のためご利用いただけません|現在ご利用いただけません|このページを閲覧する権限がありません|アクセスする権限がありません|アクセスが拒否されました|セッションの有効期限が切れました|セッションがタイムアウトしました|再度ログインしてください
この動画は再生できません|動画を再生できません|この動画は非公開です|この動画は削除されました|お住まいの地域では視聴できません|お使いの地域ではご利用いただけません
您访问的页面不存在|页面不存在|找不到页面|抱歉，找不到您要访问的页面|页面已被删除或移动|服务器错误|服务器内部错误|服务器繁忙，请稍后再试|系统繁忙，请稍后再试|网络连接超时|加载失败，请刷新重试|系统维护中|您没有权限访问此页面|访问被拒绝|登录已过期，请重新登录|该视频已被删除|视频无法播放|发生错误，请稍后重试
페이지를 찾을 수 없습니다|요청하신 페이지를 찾을 수 없습니다|존재하지 않는 페이지입니다|일시적인 오류가 발생했습니다|오류가 발생했습니다. 잠시 후 다시 시도해 주세요|서버 오류가 발생했습니다|접근 권한이 없습니다|접근이 거부되었습니다|세션이 만료되었습니다|다시 로그인해 주세요|시스템 점검 중입니다|동영상을 재생할 수 없습니다|연결 시간이 초과되었습니다
ไม่พบหน้าที่คุณต้องการ|ไม่พบหน้าที่ร้องขอ|ไม่พบหน้านี้|เกิดข้อผิดพลาด กรุณาลองใหม่อีกครั้ง|เซิร์ฟเวอร์ขัดข้อง|คุณไม่มีสิทธิ์เข้าถึงหน้านี้|ปิดปรับปรุงระบบชั่วคราว|पृष्ठ नहीं मिला|यह पेज उपलब्ध नहीं है|कुछ गलत हो गया, कृपया बाद में पुनः प्रयास करें|सर्वर में त्रुटि हुई
Seite nicht gefunden|Die angeforderte Seite wurde nicht gefunden|Die gesuchte Seite existiert nicht|Zugriff verweigert|Es ist ein Fehler aufgetreten, bitte versuchen Sie es später erneut|Fehler 0|Fehler 0 auf dem Server|Interner Serverfehler|Bitte laden Sie die Seite neu|Ihre Sitzung ist abgelaufen|Dieses Video ist nicht verfügbar|Wegen Wartungsarbeiten nicht erreichbar|Zeitüberschreitung der Verbindung
Page introuvable|Page non trouvée|La page demandée est introuvable|La page que vous recherchez n'existe pas|Cette page a été supprimée ou déplacée|Accès refusé|Vous n'avez pas l'autorisation d'accéder à cette page|Une erreur est survenue, veuillez réessayer plus tard|Erreur 0|Erreur 0 du serveur, réessayez plus tard|Erreur interne du serveur|Votre session a expiré|Cette vidéo n'est pas disponible|Site en maintenance
Página no encontrada|La página solicitada no existe|La página que busca no existe|No se ha encontrado la página|Acceso denegado|No tiene permiso para acceder a esta página|Se ha producido un error, inténtelo de nuevo más tarde|Error 0 del servidor|Error interno del servidor|Su sesión ha caducado|Este vídeo no está disponible|Sitio en mantenimiento
No response from the server|Empty response from the server|Null response from the server|Null response from service|Invalid response from the server|Unexpected response from the server|The service returned an error|The service returned no data|No data received|Empty reply from server|Failed to fetch subtitles|Failed to fetch captions|Failed to retrieve captions|Failed to retrieve data
Caption service unavailable|Caption service returned an error|Captions are not available|Subtitles are not available|Subtitle track not found|Subtitles could not be loaded|Transcript not available|Transcription failed|Transcription service error|Speech recognition failed|Recognition service timed out|Unable to connect to the server|Could not connect to the server
Unable to process your request|Request failed, status code 0|Request timed out|The request could not be processed|Service temporarily unavailable|File not found|Resource not found|Invalid request|Invalid token|Authentication failed|Authentication required|Unauthorized access|Your connection is not private|SSL handshake failed|DNS lookup failed|Could not resolve host
Network unreachable|No internet connection|Playback error|An error occurred during playback|The media could not be loaded because the server or network failed or the format is not supported|Format not supported|Internal error|Unknown error|Unhandled exception|Exception in thread main|Syntax error, unexpected token|Reference error, variable is not defined|List index out of range
Array index out of bounds|Unexpected end of JSON input|Unexpected token in JSON|Quota exceeded|API limit exceeded|Invalid API key|Maximum retries exceeded|Database error|Query failed|Could not open file
サーバーから応答がありません|応答がありません|字幕サービスに接続できません|字幕を取得できませんでした|字幕の読み込みに失敗しました|データを取得できませんでした|データの取得に失敗しました|音声認識に失敗しました|認識エラー|タイムアウトしました|処理がタイムアウトしました|リクエストがタイムアウトしました
不正なリクエストです|認証に失敗しました|ログインが必要です|ネットワークエラー|ネットワークに接続できません|インターネット接続を確認してください|接続に失敗しました|接続が拒否されました|再生エラー|再生中にエラーが発生しました|不明なエラーが発生しました|システムエラーが発生しました|内部エラーが発生しました|サービスは一時的に利用できません|サービスを利用できません
URLが正しくありません|URLをご確認ください|アドレスが間違っている可能性があります|ページを更新してください|このページは表示できません|ページを表示できません
服务器无响应|服务器未响应|服务暂时不可用|字幕加载失败|字幕获取失败|无法加载字幕|无法获取数据|数据加载失败|获取数据失败|请求超时|请求失败|连接失败|连接超时|连接被拒绝|无法连接到服务器|网络错误|网络异常|请检查网络连接|发生未知错误|出现未知错误|系统错误|内部错误|认证失败|会话已过期|文件不存在|找不到文件|资源不存在
语音识别失败|播放失败|播放出错|页面无法显示|无法访问此网站|无法访问此页面|您请求的页面不存在|您要查看的页面不存在|页面出错了|错误代码0|请刷新页面|页面加载失败|加载超时
서버에 연결할 수 없습니다|서버가 응답하지 않습니다|서버 응답이 없습니다|응답 시간이 초과되었습니다|요청 시간이 초과되었습니다|요청을 처리할 수 없습니다|자막을 불러올 수 없습니다|자막을 불러오지 못했습니다|데이터를 불러올 수 없습니다|네트워크 오류가 발생했습니다|네트워크 연결을 확인해 주세요|인터넷 연결을 확인하세요|알 수 없는 오류가 발생했습니다
시스템 오류|내부 서버 오류|서비스를 이용할 수 없습니다|서비스 점검 중입니다|인증에 실패했습니다|로그인이 필요합니다|파일을 찾을 수 없습니다|음성 인식에 실패했습니다|재생 오류|재생할 수 없는 동영상입니다|연결이 거부되었습니다|연결에 실패했습니다|페이지를 표시할 수 없습니다|삭제된 페이지입니다|새로고침해 주세요|잠시 후 다시 시도하세요|오류 코드 0
Server nicht erreichbar|Der Server antwortet nicht|Keine Antwort vom Server|Keine Verbindung zum Server|Verbindung fehlgeschlagen|Verbindung unterbrochen|Netzwerkfehler|Dienst nicht verfügbar|Dienst vorübergehend nicht verfügbar|Ein unbekannter Fehler ist aufgetreten|Ein unerwarteter Fehler ist aufgetreten|Datei nicht gefunden|Untertitel konnten nicht geladen werden|Untertitel nicht verfügbar|Daten konnten nicht geladen werden
Laden fehlgeschlagen|Anmeldung erforderlich|Anfrage fehlgeschlagen|Zeitüberschreitung der Anfrage|Spracherkennung fehlgeschlagen|Wiedergabefehler|Diese Seite ist nicht verfügbar|Die Seite kann nicht angezeigt werden|Etwas ist schiefgelaufen|Sie haben keine Berechtigung, diese Seite anzuzeigen|Sitzung abgelaufen, bitte melden Sie sich erneut an|Ungültige Anfrage
Le serveur ne répond pas|Aucune réponse du serveur|Serveur indisponible|Impossible de se connecter au serveur|Connexion refusée|Connexion interrompue|Délai d'attente dépassé|Délai de connexion dépassé|Erreur réseau|Erreur inconnue|Une erreur inattendue s'est produite|Service temporairement indisponible
Impossible de charger la page|Échec du chargement|Échec de la connexion|Échec de la reconnaissance vocale|Requête invalide|Requête expirée|Veuillez réessayer plus tard|Veuillez vous reconnecter|Veuillez actualiser la page|Erreur de lecture|Contenu indisponible|Page indisponible|Accès interdit
El servidor no responde|Sin respuesta del servidor|No se pudo conectar con el servidor|Conexión rechazada|Tiempo de espera agotado|Tiempo de conexión agotado|Error desconocido|Ha ocurrido un error inesperado|Se produjo un error inesperado|Algo salió mal, inténtelo de nuevo|Servicio no disponible|Servicio temporalmente no disponible|Archivo no encontrado|No se pudieron cargar los subtítulos|Subtítulos no disponibles
No se pudo cargar la página|No se pudo cargar el video|Error al cargar|Error de conexión|Error de reproducción|Falló el reconocimiento de voz|Solicitud no válida|Solicitud incorrecta|Vuelva a intentarlo más tarde|Actualice la página|Inicie sesión de nuevo|Contenido no disponible|Página no disponible|Acceso prohibido
เซิร์ฟเวอร์ไม่ตอบสนอง|ไม่สามารถเชื่อมต่อเซิร์ฟเวอร์ได้|เชื่อมต่อล้มเหลว|การเชื่อมต่อหมดเวลา|ข้อผิดพลาดของเครือข่าย|เกิดข้อผิดพลาดที่ไม่ทราบสาเหตุ|เกิดข้อผิดพลาดภายในเซิร์ฟเวอร์|บริการไม่พร้อมใช้งาน|ไม่พบไฟล์|ไม่สามารถโหลดคำบรรยายได้|โหลดคำบรรยายไม่สำเร็จ|ไม่สามารถโหลดหน้านี้ได้|โปรดลองอีกครั้งในภายหลัง|เซสชันหมดอายุ กรุณาเข้าสู่ระบบใหม่|ปฏิเสธการเข้าถึง|วิดีโอนี้ไม่พร้อมใช้งาน|ข้อผิดพลาด 0
सर्वर से कोई प्रतिक्रिया नहीं|सर्वर जवाब नहीं दे रहा है|सर्वर से कनेक्ट नहीं हो सका|कनेक्शन विफल|कनेक्शन का समय समाप्त|नेटवर्क त्रुटि|अज्ञात त्रुटि|आंतरिक सर्वर त्रुटि|सेवा उपलब्ध नहीं है|फ़ाइल नहीं मिली|उपशीर्षक लोड नहीं हो सके|पेज लोड नहीं हो सका|पहुँच अस्वीकृत|आपका सत्र समाप्त हो गया है|कृपया पुनः लॉगिन करें|यह वीडियो उपलब्ध नहीं है|त्रुटि 0
"""

SCRIPT = """
Please enable JavaScript|Please enable JavaScript to continue|Please enable JavaScript in your browser settings|JavaScript is disabled|JavaScript is disabled in your browser|JavaScript is turned off in your browser|JavaScript is switched off|JavaScript is not enabled
This site requires JavaScript|This page requires JavaScript to work|JavaScript is required to view this page|JavaScript must be enabled to use this site|It is necessary to enable JavaScript for full functionality|Your browser does not support JavaScript|Your browser does not run scripts
Please turn on JavaScript and reload the page|Enable JavaScript and cookies to continue|We've detected that JavaScript is disabled in your browser|Scripts are blocked|Scripts are disabled in your browser|Allow scripts to run|This page needs scripts|noscript
JavaScriptを有効にしてください|JavaScriptが無効になっています|お使いのブラウザではJavaScriptが無効になっています|このページを表示するにはJavaScriptを有効にする必要があります|JavaScriptをオンにしてください|JavaScriptがオフになっています|JavaScriptがオフのため表示できません
当サイトではJavaScriptを使用しています|JavaScriptに対応していません|スクリプトが無効です|スクリプトが無効になっています|スクリプトの実行を許可してください|スクリプトを有効にしてください|ブラウザの設定をご確認ください
请启用JavaScript|请启用JavaScript后继续|您的浏览器不支持JavaScript|您的浏览器已禁用JavaScript|请开启JavaScript后刷新页面|请在浏览器设置中启用脚本|자바스크립트를 활성화해 주세요|자바스크립트가 꺼져 있습니다|자바스크립트를 켜세요|자바스크립트를 사용할 수 없습니다|이 사이트는 자바스크립트가 필요합니다|스크립트를 허용해 주세요
โปรดเปิดใช้งาน JavaScript|กรุณาเปิดใช้งาน JavaScript ในเบราว์เซอร์ของคุณ|เบราว์เซอร์ของคุณไม่รองรับ JavaScript|कृपया JavaScript सक्षम करें|आपके ब्राउज़र में JavaScript अक्षम है|JavaScript चालू करें
Bitte aktivieren Sie JavaScript|JavaScript ist in Ihrem Browser deaktiviert|Diese Seite benötigt JavaScript|Diese Seite benötigt aktivierte Skripte|Ihr Browser unterstützt kein JavaScript|Skripte sind deaktiviert
Veuillez activer JavaScript|JavaScript est désactivé dans votre navigateur|Cette page nécessite JavaScript|Ce site a besoin de scripts pour fonctionner|Votre navigateur ne prend pas en charge JavaScript|Les scripts sont désactivés
Active JavaScript para continuar|Active JavaScript para ver esta página|JavaScript está desactivado en su navegador|Este sitio requiere JavaScript|Habilite JavaScript|Su navegador no admite JavaScript|Los scripts están desactivados
Scripts must be enabled|Scripts must be enabled to display this page|Enable scripts to view this page|Your browser blocks scripts|JavaScript has been blocked|Script execution is disabled|This player requires JavaScript|To view captions, enable JavaScript|Captions need JavaScript
ブラウザのJavaScript設定を有効にしてください|字幕を表示するにはJavaScriptを有効にしてください
请允许运行脚本|脚本已被禁用|脚本被阻止|请打开JavaScript|需要启用脚本才能显示|本页面需要JavaScript支持|浏览器未启用JavaScript|스크립트가 차단되었습니다|스크립트가 비활성화되어 있습니다|브라우저에서 스크립트를 허용하세요|자바스크립트가 비활성화되어 있습니다|자바스크립트를 허용해 주세요
Skripte sind blockiert|Bitte Skripte zulassen|JavaScript ist ausgeschaltet|JavaScript muss aktiviert sein|Für diese Seite muss JavaScript aktiviert sein|Ihr Browser blockiert Skripte
Les scripts sont bloqués|Autorisez les scripts|JavaScript doit être activé|JavaScript n'est pas activé|JavaScript est requis
Los scripts están bloqueados|Permita los scripts|JavaScript debe estar habilitado|Se requiere JavaScript|JavaScript no está habilitado|JavaScript está deshabilitado
จำเป็นต้องเปิด JavaScript|JavaScript ถูกปิดใช้งาน|สคริปต์ถูกปิดใช้งาน|กรุณาอนุญาตสคริปต์|หน้านี้ต้องใช้ JavaScript|JavaScript बंद है|स्क्रिप्ट अक्षम है|कृपया स्क्रिप्ट चालू करें|इस पेज के लिए JavaScript आवश्यक है
"""


def listed(text: str) -> list[str]:
    """The passages of one of the lists."""
    return [p.strip() for line in text.strip().split("\n") for p in line.split("|")]


def passages() -> list[tuple[str, str]]:
    """(kind, passage): all exemplars but filler; those of HTTP's errors are made of its reason phrases."""
    out = [("template", p) for p in listed(TEMPLATE)]
    out += [("repeated", (u if not u.isascii() else u + " ") * 3) for u in UNITS] + [("repeated", r) for r in ROWS]
    out += [("error", p) for p in listed(ERROR)]
    for s in HTTPStatus:
        if s >= 400:
            out += [("error", form.format(s.phrase)) for form in ("0 {}", "{} status 0", "{} error 0", "error 0: {}", "HTTP 0: {}")]
    out.append(("error", "0 Gateway Time-out"))
    out += [("script", p) for p in listed(SCRIPT)]
    return list(dict.fromkeys(out))
