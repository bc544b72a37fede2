"""Messages of well-known products and plain speech, written down apart from the exemplars.

Fixed values. ``RESIDUE`` are messages, placeholders and filler as products show them; ``SPEECH`` mentions such things. The
thresholds were chosen with these two; ``FRESH`` and ``FRESH_SPEECH`` were written afterwards and nothing was changed for them.
"""

RESIDUE = """
You need to enable JavaScript to run this app.
Please turn JavaScript on and reload the page.
JavaScript seems to be disabled in your browser. For the best experience on our site, be sure to turn on Javascript in your browser.
This application requires JavaScript to be enabled.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Sorry, you need to enable JavaScript to visit this website.
Your browser has JavaScript turned off. Some features of this site will not work.
This feature requires JavaScript.
Scripting is disabled in your browser, please enable scripts.
この機能を利用するにはJavaScriptを有効にする必要があります。
ご利用のブラウザはJavaScriptが無効に設定されています。有効にしてください。
本サイトを快適にご利用いただくにはJavaScriptを有効にしてください。
本网站需要启用JavaScript才能正常显示。
JavaScript를 사용하도록 설정해 주세요.
이 페이지를 보려면 자바스크립트를 활성화해야 합니다.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um fortzufahren.
Pour utiliser ce site, veuillez activer JavaScript dans votre navigateur.
Debe habilitar JavaScript en su navegador para ver esta página.
The requested URL /index.php was not found on this server.
The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable.
Sorry, the page you were looking for could not be found.
Oops! We can't find the page you're looking for.
HTTP Error 404. The requested resource is not found.
404 | This page could not be found.
This page isn't available. Sorry about that.
503 Service Temporarily Unavailable
502 Bad Gateway nginx
You don't have permission to access / on this server.
Your connection was interrupted.
Sorry, something went wrong. We're working on getting this fixed as soon as we can.
An error occurred while processing your request.
An internal server error occurred. Please try again later.
Your session has expired. Please sign in again.
This video isn't available anymore.
The uploader has not made this video available in your country.
Service unavailable. The server is temporarily busy, please try again later.
We are currently performing scheduled maintenance. We will be back soon.
Access to this resource on the server is denied.
Error: Request failed with status code 500
Connection timed out. The server took too long to respond.
お探しのページは移動または削除された可能性があります。
大変申し訳ございません。お探しのページが見つかりませんでした。
アクセスが集中し、ページを閲覧しにくい状態になっております。
只今メンテナンス中のため、サービスをご利用いただけません。
このページは現在表示できません。時間をおいて再度お試しください。
サーバーとの接続が切断されました。
予期せぬエラーが発生しました。しばらくしてから再度お試しください。
この動画は現在ご利用いただけません。
ページの有効期限が切れています。再度ログインしてください。
抱歉，您访问的页面不存在或已被删除。
服务器出错了，请稍后再试。
网络异常，请稍后重试。
죄송합니다. 요청하신 페이지를 찾을 수 없습니다.
서비스 이용에 불편을 드려 죄송합니다. 잠시 후 다시 시도해 주세요. 오류가 발생했습니다.
Die von Ihnen gesuchte Seite konnte nicht gefunden werden.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.
Désolé, la page que vous avez demandée est introuvable.
Une erreur inattendue est survenue. Veuillez réessayer ultérieurement.
Lo sentimos, la página que busca no se encuentra disponible.
Se produjo un error inesperado. Inténtelo de nuevo.
Hello {{first_name}}, thanks for signing up.
Dear ${customerName}, your order has shipped.
<%= user.email %> has joined.
Hi %(username)s, welcome back.
{% include header %} Good evening.
Dear [NAME], thanks for your order.
<INSERT TITLE HERE>
Good evening from [insert city here].
{0} of {1} items
Your order [[orderId]] is on its way.
*|FNAME|*, here is the news
こんにちは、{{userName}}さん。
【会社名を入力してください】の提供でお送りします。
[Your Name] reporting from the studio.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.
Click here to add your title
Enter your caption here.
ここにタイトルを入力してください
ここにテキストが入ります。ここにテキストが入ります。
これはダミーテキストです。
単击此处添加文本
여기에 제목을 입력하세요
Geben Sie hier Ihren Text ein
Cliquez pour ajouter du texte
Haga clic para agregar texto
test test test
サンプルテキストサンプルテキスト
あいうえおかきくけこさしすせそたちつてと
""".strip().split("\n")

SPEECH = """
We talked about JavaScript all evening and she still prefers the other language.
The page was torn out of the book, so nobody knows how the story ends.
My server at the restaurant was temporarily out of coffee.
He went to the door marked 404 but it was not open.
Something went wrong with the cake, but we ate it anyway.
The video from the wedding is still on my phone.
She denied that she had access to the tower.
They asked us to try the soup again later in the week.
The connection at Osaka was late and we missed the boat.
Our session with the choir lasted until nine.
He enabled the alarm and turned the lights off.
The author left the last page blank on purpose.
You need to run if you want to catch the train.
Please continue to the next stop and wait for me.
Your name came up at dinner, he told me.
The actors read the script together for the first time today.
In Latin class we learned what dolor means.
I found the sample of the cloth you asked for.
Insert the coin and press the green button.
Type a letter to your grandmother, she will be glad.
The museum is closed for maintenance of the roof until May.
There were 500 people at the internal meeting.
The gateway to the old town was built in 1404.
JavaScriptの本を貸したまま返ってこない。
このページの絵がいちばん好きなんだ。
サーバーの仕事は重い皿を運ぶから大変だよ。
駅のメンテナンスで電車が遅れているらしい。
見つかりませんでした、鍵はどこにも。
時間をおいて煮るともっとおいしくなります。
その話は文字にすると長くなるよ。
彼のエラーで試合に負けたんだ。
タイトルを取った力士が祝杯をあげた。
会社名を変えることに決めました。
我在书的最后一页写了名字。
服务员说请稍后再来。
그 책의 마지막 페이지를 찢었어요.
서버가 물을 가져왔어요.
Die Seite des Hauses ist blau gestrichen.
Ich habe den Fehler in der Rechnung gefunden.
La page du livre était déchirée.
Elle a activé le chauffage avant de partir.
La página del libro estaba rota.
Se fue la luz y no pudimos ver la película.
He put the braces { and } on the blackboard.
The sign says [EXIT] in red letters.
They charge 50% (half) on Mondays.
""".strip().split("\n")

FRESH = """
Enable JavaScript in your browser to use this feature.
Sorry, our website needs JavaScript in order to work.
Looks like your browser doesn't support JavaScript.
JavaScript must be turned on to play this video.
Without scripts this page cannot be displayed.
JavaScriptが無効なため、一部の機能がご利用いただけません。
ブラウザのJavaScriptをオンにしてから再度アクセスしてください。
您的浏览器未启用JavaScript，请启用后重试。
브라우저에서 자바스크립트가 비활성화되어 있습니다.
Für diese Website muss JavaScript aktiviert sein.
Veuillez activer les scripts pour afficher cette page.
Necesita activar JavaScript para usar este sitio.
Sorry, this page doesn't exist.
The page you have requested does not exist on this server.
We couldn't find that page.
Error 403: Forbidden
HTTP 500 Internal Server Error
429 Too Many Requests
Request timeout. Please refresh the page.
The server is currently unavailable. Try again later.
You do not have access to this page.
Unable to connect to the server.
The connection to the server was reset.
Something went wrong. Try reloading the page.
Your session timed out due to inactivity. Please log in again.
This video has been removed.
This content isn't available in your country.
Uncaught TypeError: Cannot read property of undefined
このページは存在しないか、削除された可能性があります。
ただいまサーバーが混雑しております。しばらくしてから再度アクセスしてください。
システムエラーが発生しました。
通信がタイムアウトしました。
お使いの環境ではこの動画を再生できません。
アクセス権限がありません。
页面加载失败，请稍后再试。
您没有访问该页面的权限。
서버에 연결할 수 없습니다. 잠시 후 다시 시도해 주세요.
페이지가 존재하지 않거나 삭제되었습니다.
Die Seite wurde leider nicht gefunden.
Ein interner Serverfehler ist aufgetreten.
Oups, cette page n'existe pas.
Erreur de serveur. Merci de réessayer plus tard.
Esta página no existe.
Error interno. Inténtelo más tarde.
ไม่พบหน้าเว็บที่คุณร้องขอ
क्षमा करें, यह पेज नहीं मिला
Welcome, ${user.firstName}!
This episode is brought to you by {sponsor_name}.
Good night from {% city %}.
<company name here> presents
【番組名】をお送りしました。
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia.
At vero eos et accusamus et iusto odio dignissimos ducimus.
Write your text here
This is just some dummy text.
ここに見出しを入力
ダミーテキストが入ります。
请输入标题
텍스트를 입력하세요
Fügen Sie hier Ihren Text ein
Saisissez un titre ici
Escriba aquí el texto
blah blah blah
テストテストテストテスト
""".strip().split("\n")

FRESH_SPEECH = """
The server brought the wrong soup twice.
Read me the first page of the letter again.
He could not connect the hose to the tap.
Our guide got lost and the tour was cancelled.
She wrote a script for the school play.
I was denied a loan at the bank.
Please enter through the back door.
Try the bread again later, it is still hot.
The bus to the country timed it badly.
Write your aunt a letter here at the table.
This is just some old bread.
The text of the song is hard to learn.
The gate was forbidden to visitors at night.
最後のページを読んで泣いてしまった。
彼はサーバーの横に座っていた。
エラーの多い試合だったね。
ここに座って、名前を呼ばれるまで待ってください。
アクセスのいい宿を選びました。
テストの点が悪くて叱られた。
这本书的第一页不见了。
他没有权利这样做。
선생님이 책을 읽어 주셨어요.
잠시 후에 다시 올게요.
Die Seite ist leider zerrissen.
Er schreibt den Text an die Tafel.
Elle a tourné la page et souri.
Esta página es la más bonita.
มีหน้าหนึ่งที่ฉันชอบ
यह किताब बहुत अच्छी है
There were 429 people at the fair.
""".strip().split("\n")
