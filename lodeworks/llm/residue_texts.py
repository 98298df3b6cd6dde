"""Texts that the models of ``residue`` are fitted on, one to a line.

All are common public messages and sample texts: default pages of web servers, frameworks,
hosting and content systems, browsers' network errors, error output of languages and
databases, script notices, sample texts of site builders and office programs, pangrams,
and the Latin and German dummy texts of typesetters.
"""

# Filler and unwritten content.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis, unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa, quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt, explicabo. Nemo enim ipsam voluptatem, quia voluptas sit, aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos, qui ratione voluptatem sequi nesciunt, neque porro quisquam est, qui dolorem ipsum, quia dolor sit amet consectetur adipisci velit, sed quia non numquam eius modi tempora incidunt, ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur? Quis autem vel eum iure reprehenderit, qui in ea voluptate velit esse, quam nihil molestiae consequatur, vel illum, qui dolorem eum fugiat, quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus, qui blanditiis praesentium voluptatum deleniti atque corrupti, quos dolores et quas molestias excepturi sint, obcaecati cupiditate non provident, similique sunt in culpa, qui officia deserunt mollitia animi, id est laborum et dolorum fuga. Et harum quidem rerum facilis est et expedita distinctio.
Nam libero tempore, cum soluta nobis est eligendi optio, cumque nihil impedit, quo minus id, quod maxime placeat, facere possimus, omnis voluptas assumenda est, omnis dolor repellendus. Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet, ut et voluptates repudiandae sint et molestiae non recusandae.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod gravida. Duis ac tellus et risus vulputate vehicula. Donec lobortis risus a elit. Etiam tempor.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante. Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est. Mauris placerat eleifend leo.
Aliquam erat volutpat. Phasellus viverra nulla ut metus varius laoreet. Quisque rutrum. Maecenas nec odio et ante tincidunt tempus. Vivamus elementum semper nisi. Praesent dapibus, neque id cursus faucibus. Proin gravida nibh vel velit auctor aliquet. Cras ornare tristique elit. Suspendisse potenti.
Welcome to your new site. Edit or delete this post, then start writing!
This is an example page. It's different from a blog post because it will stay in one place and will show up in your site navigation (in most themes). Most people start with an About page that introduces them to potential site visitors.
Hi, this is a comment. To get started with moderating, editing, and deleting comments, please visit the Comments screen in the dashboard.
I'm a paragraph. Click here to add your own text and edit me. It's easy. Just click "Edit Text" or double click me to add your own content and make changes to the font. I'm a great place for you to tell a story and let your users know a little more about you.
This is a great space to write a long text about your company and your services. You can use this space to go into a little more detail about your company. Talk about your team and what services you provide.
Use this text to share information about your brand with your customers. Describe a product, share announcements, or welcome customers to your store.
Pair text with an image to focus on your chosen product, collection, or blog post. Add details on availability, style, or even provide a review.
Click the edit button to change this text. Add your heading text here. Enter your subtitle here. Button text. Learn more.
To get started right away, just tap any placeholder text (such as this) and start typing to replace it with your own. Replace this with your own content.
Click to add title. Click to add text. Click to edit the title style. Second level. Third level. Fourth level. Fifth level.
Some quick example text to build on the card title and make up the bulk of the card's content. This is a wider card with supporting text below as a natural lead-in to additional content. This content is a little bit longer.
Placeholder content for this panel. This is some placeholder content to show the layout. And some more placeholder text, to fill the space and show how it wraps.
This is dummy copy. It is not meant to be read. It has been placed here solely to demonstrate the look and feel of finished, typeset text. Only for show. He who searches for meaning here will be sorely disappointed.
Insert your text here. Type your message here. Enter a description for this item. Description goes here. Title goes here. Quote goes here. Write something about yourself. Add some text about this section.
Your content goes here. Edit or remove this text inline or in the module content settings. You can also style every aspect of this content in the design settings.
This section will be filled in later. Content to be added. Text to come. More details to follow. To be announced. To be completed. Pending copy from client. Final text to be supplied by the editor.
Coming soon. Under construction. This page is under construction. Check back later for new content. This page intentionally left blank.
Your company name. Your address line 1. Your tagline here. Company slogan. First name Last name. Job title. Phone number. Street address. City, State, ZIP code. name@example.com
Sample headline. Sample paragraph text. Example text block. Placeholder image. Placeholder title. Default description. Product name. Product description. Author name. Category name. Post title.
Photo caption. Insert image here. Image placeholder. Alternative text for the picture. Figure 1. Figure caption. Click to upload a picture. Add an image. 300 x 250. 600x400.
List item one. List item two. List item three. First item. Second item. Third item. Header 1. Header 2. Column 1. Column 2. Row 1. Cell 1. Option 1. Option 2. Feature one. Feature two.
Article title. Untitled document. Untitled page. New post. New page. Untitled. No title. Draft. Example page. Test post. Test page, please ignore. Testing, testing, one two three.
The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs. Sphinx of black quartz, judge my vow. How vexingly quick daft zebras jump! The five boxing wizards jump quickly.
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789. asdf jkl; qwertyuiop asdfghjkl zxcvbnm. aaaa bbbb cccc dddd. foo bar baz qux quux. blah blah blah. hello test test. test 123.
xxx xxx xxx xxxx xxxxx. XXXX XXX XXXXX XX. yyyy yyyyy. ???? ??? --- n/a n/a n/a. ... ... ... TK TK. Lorem lorem lorem.
TODO add content. TODO finish this part. TODO fill in the details. FIXME missing text. TBD by marketing. TBA. To do: describe the feature. Need copy. Add text. Fill me in.
Bacon ipsum dolor amet short ribs brisket venison rump drumstick pig sausage prosciutto chicken spare ribs salami picanha doner.
Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte. Abgeschieden wohnen sie in Buchstabhausen an der Küste des Semantik, eines großen Sprachozeans. Ein kleiner Bach namens Duden fließt durch ihren Ort und versorgt sie mit den nötigen Regelialien.
Dies ist ein Typoblindtext. An ihm kann man sehen, ob alle Buchstaben da sind und wie sie aussehen. Überall dieselbe alte Leier. Das Layout ist fertig, der Text lässt auf sich warten. Damit das Layout nun nicht nackt im Raume steht und sich klein und leer vorkommt, springe ich ein: der Blindtext.
Klicken Sie hier, um Ihren eigenen Text hinzuzufügen. Dies ist eine Beispielseite. Fügen Sie hier Ihre Überschrift ein. Hier kommt später der eigentliche Inhalt hin. Beispieltext für diesen Bereich. Platzhalter für den Inhalt. Der Inhalt folgt demnächst.
Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. Franz jagt im komplett verwahrlosten Taxi quer durch Bayern.
Ceci est un exemple de page. C'est différent d'un article de blog, parce qu'elle restera au même endroit. Cliquez ici pour ajouter votre propre texte. Saisissez votre titre ici. Texte provisoire. Texte d'exemple pour cette rubrique, à remplacer par le contenu définitif. Contenu à venir prochainement.
Portez ce vieux whisky au juge blond qui fume. Voix ambiguë d'un cœur qui au zéphyr préfère les jattes de kiwis.
Esta es una página de ejemplo. Haz clic aquí para añadir tu propio texto. Texto de relleno. Escribe aquí tu texto. Contenido próximamente.
आपकी साइट पर आपका स्वागत है। यह आपकी पहली पोस्ट है। इसे संपादित करें या हटाएं, फिर लिखना शुरू करें! शीर्षक जोड़ने के लिए क्लिक करें। पाठ जोड़ने के लिए क्लिक करें। यहाँ विवरण दर्ज करें। यह केवल उदाहरण के लिए पाठ है। सामग्री शीघ्र आ रही है।
Это пример страницы. Нажмите здесь, чтобы добавить свой текст. Текст-заполнитель. Введите заголовок. Раздел находится в разработке.
ಇಲ್ಲಿ ನಿಮ್ಮ ಪಠ್ಯವನ್ನು ಸೇರಿಸಿ. ಶೀರ್ಷಿಕೆ ಸೇರಿಸಲು ಕ್ಲಿಕ್ ಮಾಡಿ. ఇక్కడ మీ వచనాన్ని చేర్చండి. శీర్షికను జోడించడానికి క్లిక్ చేయండి.
""".strip()

# Error pages, error output, script notices and refusals.
NOTICE = """
404 Not Found nginx/1.18.0
403 Forbidden nginx
500 Internal Server Error nginx/1.14.2
502 Bad Gateway openresty/1.19.9.1
503 Service Temporarily Unavailable nginx
504 Gateway Time-out nginx/1.10.3
413 Request Entity Too Large
400 Bad Request The plain HTTP request was sent to HTTPS port
Not Found The requested URL /about.html was not found on this server. Apache/2.4.41 Server at localhost Port 80
Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.
Forbidden You don't have permission to access this resource. Server unable to read htaccess file, denying access to be safe
Internal Server Error The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator to inform them of the time this error occurred, and the actions you performed just before this error. More information about this error may be available in the server error log.
Service Unavailable The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
Bad Request Your browser sent a request that this server could not understand.
Unauthorized This server could not verify that you are authorized to access the document requested. Either you supplied the wrong credentials, or your browser doesn't understand how to supply the credentials required.
Request Timeout Server timeout waiting for the HTTP request from the client. Method Not Allowed. Length Required. Gone. Not Acceptable.
Proxy Error The proxy server received an invalid response from an upstream server. The proxy server could not handle the request. Reason: Error reading from remote server
Bandwidth Limit Exceeded The server is temporarily unable to service your request due to the site owner reaching the bandwidth limit. Please try again later.
HTTP Error 404.0 - Not Found The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
HTTP Error 503. The service is unavailable. HTTP Error 500.19 - Internal Server Error The requested page cannot be accessed because the related configuration data for the page is invalid.
Server Error in '/' Application. Runtime Error. Description: An application error occurred on the server. The current custom error settings for this application prevent the details of the application error from being viewed remotely.
403 - Forbidden: Access is denied. You do not have permission to view this directory or page using the credentials that you supplied.
HTTP Status 404 - Not Found. Type Status Report. Description The origin server did not find a current representation for the target resource or is not willing to disclose that one exists.
HTTP Status 500 - Internal Server Error. Type Exception Report. Message Unable to compile class for JSP. The server encountered an unexpected condition that prevented it from fulfilling the request.
Whitelabel Error Page. This application has no explicit mapping for /error, so you are seeing this as a fallback. There was an unexpected error (type=Not Found, status=404). No message available
Error 503 Backend fetch failed. Guru Meditation: XID: 32770. Cache server
Error 522 Connection timed out. The initial connection between the network and the origin web server timed out. As a result, the web page can not be displayed. Error 521 Web server is down. Error 524 A timeout occurred. Error 520 Web server is returning an unknown error.
Error 1020 Access denied. What happened? This website is using a security service to protect itself from online attacks. The action you just performed triggered the security solution.
Sorry, you have been blocked. You are unable to access this website. Why have I been blocked? What can I do to resolve this? You can email the site owner to let them know you were blocked.
Checking your browser before accessing example.com. This process is automatic. Your browser will redirect to your requested content shortly. Please allow up to 5 seconds...
Just a moment... Verify you are human by completing the action below. The site needs to review the security of your connection before proceeding. Ray ID: 7d1b2c3d4e5f6a7b
Why do I have to complete a CAPTCHA? Completing the CAPTCHA proves you are a human and gives you temporary access to the web property.
One more step. Please complete the security check to access the page. Press and hold to confirm you are a human and not a bot. Reference ID 3f1c2ab0.
Pardon our interruption. As you were browsing something about your browser made us think you were a bot. You've disabled JavaScript in your web browser. Cookies were disabled.
Access Denied You don't have permission to access this page on this server. Reference #18.2d351ab8.1557333295.a4e16ab
The request could not be satisfied. Request blocked. We can't connect to the server for this app or website at this time. There might be too much traffic or a configuration error. Try again later, or contact the app or website owner. Request ID: 8Qx2b
<Error><Code>AccessDenied</Code><Message>Access Denied</Message><RequestId>4442587FB7D0A2F9</RequestId></Error> <Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message></Error>
404. That's an error. The requested URL was not found on this server. That's all we know.
Our systems have detected unusual traffic from your computer network. This page checks to see if it's really you sending the requests, and not a robot.
There isn't a site here. If you're trying to publish one, read the full documentation to learn how to set up your site. File not found. The site configured at this address does not contain the requested file.
Application error. An error occurred in the application and your page could not be served. If you are the application owner, check your logs for details. No such app. There is no app configured at that hostname.
This site can't be reached. The server IP address could not be found. Try checking the connection, the proxy, the firewall and the DNS configuration. ERR_NAME_NOT_RESOLVED ERR_CONNECTION_REFUSED ERR_TIMED_OUT
This page isn't working right now. The site didn't send any data. ERR_EMPTY_RESPONSE. The site redirected you too many times. ERR_TOO_MANY_REDIRECTS
Your connection is not private. Attackers might be trying to steal your information. NET::ERR_CERT_AUTHORITY_INVALID. Warning: Potential Security Risk Ahead. Secure Connection Failed.
Aw, Snap! Something went wrong while displaying this webpage. Error code: Out of Memory. You're offline. No internet connection.
Hmm. We're having trouble finding that site. We can't connect to the server. Unable to connect. The connection was reset. The connection to the server was reset while the page was loading.
The connection has timed out. The server is taking too long to respond. The site could be temporarily unavailable or too busy. Try again in a few moments.
The page cannot be displayed. The page you are looking for is currently unavailable. The web site might be experiencing technical difficulties, or you may need to adjust your browser settings.
That page can't be found. It looks like nothing was found at this location. Maybe try one of the links below or a search?
Nothing Found. Sorry, but nothing matched your search terms. Please try again with some different keywords.
Briefly unavailable for scheduled maintenance. Check back in a minute. Maintenance Page. Undergoing Scheduled Maintenance.
There has been a critical error on this website. Please check your site admin email inbox for instructions. Learn more about troubleshooting.
We could not connect to the database. This either means that the username and password information in your configuration file is incorrect or that contact with the database server could not be established.
Are you sure you want to do this? The link you followed has expired. Cheatin' huh? Sorry, you are not allowed to access this page. You do not have sufficient permissions to access this page.
The requested page could not be found. You are not authorized to access this page. The website encountered an unexpected error. Please try again later.
An error has occurred while processing your request. You may not be able to visit this page because of an out-of-date bookmark, a search engine that has an out-of-date listing for this site, a mistyped address, you have no access to this page, or the requested resource was not found.
We're sorry, but something went wrong. If you are the application owner check the logs for more information. The change you wanted was rejected. Maybe you tried to change something you didn't have access to.
The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved. The page you requested has been removed, renamed or is no longer here. Go to the home page.
Page not found (404). Request Method: GET. Using the URLconf defined in mysite.urls, these URL patterns were tried, in this order. The current path didn't match any of these. You're seeing this error because you have DEBUG = True in your settings file.
CSRF verification failed. Request aborted. Server Error (500). Whoops, looks like something went wrong. 419 Page Expired. 429 Too Many Requests. 401 Unauthorized. 405 Method Not Allowed. Error: Forbidden
Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed. Sorry, this content isn't available at the moment. This post is unavailable. The content you requested has been deleted by its owner.
We recognize you are attempting to access this website from a country which enforces the General Data Protection Regulation and therefore access cannot be granted at this time. Unfortunately, our website is currently unavailable in most European countries.
The uploader has not made this video available in your country. This title is not offered in your region. Due to legal reasons, this content cannot be shown in your location.
You have exceeded your request quota. API rate limit exceeded. You have sent too many requests in a given amount of time. Slow down and wait a few minutes before you try again. Quota exceeded.
Your session has timed out due to inactivity. Please log in again. You have been logged out. Login required. Please log in to access this page. You need to be a member to read this content. Subscribe to continue reading.
You don't have access to this document. Request access, or switch to an account with access. Ask the owner for permission. You need permission. This file is private.
This account has been disabled. Contact your hosting provider for more information. This website has been suspended by the hosting company. Account Suspended.
This domain name has expired. This web page is parked free, courtesy of the registrar. The domain may be for sale by its owner. Buy this domain. Future home of something quite cool. Website coming soon. Default web page of the hosting account.
We are performing scheduled maintenance. We should be back online shortly. We'll be back soon! Sorry for the inconvenience, we're performing some maintenance at the moment. The site is currently down for maintenance, thank you for your patience.
The service you requested is temporarily overloaded. Please wait and retry your request. The server is busy. Temporarily out of service. Upstream connect error or disconnect/reset before headers. no healthy upstream. upstream request timeout
Something went wrong. Try again. An unknown error occurred. Unexpected error. Please reload the page. Reload. Retry. If the problem persists, contact support. Error code: 0x80070005. Error reference number: 8c1f. Transaction ID 12fe09.
Oh no! Something bad happened. Please come back later when we fixed that problem. Thanks. We hit a snag. We're working to fix the problem. Houston, we have a problem.
Fatal error: Uncaught Error: Call to undefined function get_header() in /home/user/public_html/wp-content/themes/basic/index.php:12 Stack trace: #0 {main} thrown in /home/user/public_html/index.php on line 17
Warning: Cannot modify header information - headers already sent by (output started at /srv/www/htdocs/config.php:1) in /srv/www/htdocs/login.php on line 24
Warning: include(): Failed opening 'header.inc' for inclusion (include_path='.:/usr/share/php') in /var/www/page.php on line 3
Notice: Undefined variable: row in /var/www/shop/list.php on line 55. Notice: Undefined offset: 1. Deprecated: Function create_function() is deprecated. Strict Standards: Only variables should be passed by reference
Parse error: syntax error, unexpected '}', expecting end of file in /var/www/html/functions.php on line 101. Maximum execution time of 30 seconds exceeded. Allowed memory size of 134217728 bytes exhausted (tried to allocate 20480 bytes)
Warning: mysqli_connect(): (HY000/2002): Connection refused. SQLSTATE[HY000] [2002] No such file or directory. You have an error in your SQL syntax; check the manual that corresponds to your server version for the right syntax to use near '' at line 1
ORA-00942: table or view does not exist. ERROR: relation "users" does not exist at character 15. Too many connections. Lost connection to MySQL server during query. could not connect to server: Connection refused. Is the server running on host "localhost" and accepting TCP/IP connections on port 5432?
Traceback (most recent call last): File "/usr/lib/python3/dist-packages/flask/app.py", line 1950, in full_dispatch_request rv = self.dispatch_request() File "main.py", line 7, in index return data["id"] KeyError: 'id'
  File "/home/app/manage.py", line 22, in main TypeError: 'NoneType' object is not subscriptable
  File "<stdin>", line 1, in <module> ZeroDivisionError: division by zero
ModuleNotFoundError: No module named 'requests'. AttributeError: 'str' object has no attribute 'decode'. NameError: name 'x' is not defined. RuntimeError: dictionary changed size during iteration. ConnectionError: Max retries exceeded with url. RecursionError: maximum recursion depth exceeded
Exception in thread "main" java.lang.ArrayIndexOutOfBoundsException: Index 5 out of bounds for length 3 at com.acme.tool.Parser.parse(Parser.java:88) at com.acme.tool.Main.main(Main.java:14)
java.sql.SQLException: Connection is closed	at org.acme.db.Pool.take(Pool.java:215)	at java.base/java.lang.Thread.run(Thread.java:829) Caused by: java.io.IOException: Stream closed ... 24 more
	at org.apache.catalina.core.ApplicationFilterChain.doFilter(ApplicationFilterChain.java:166)
	at javax.servlet.http.HttpServlet.service(HttpServlet.java:731)
TypeError: Cannot read property 'length' of undefined at Object.<anonymous> (/app/server.js:10:15) at Module._compile (internal/modules/cjs/loader.js:1063:30) UnhandledPromiseRejectionWarning: Error: connect ECONNREFUSED 127.0.0.1:3000
System.NullReferenceException: Object reference not set to an instance of an object. at Acme.Web.Controllers.HomeController.Index() in C:\\build\\HomeController.cs:line 25
NoMethodError: undefined method `name' for nil:NilClass app/controllers/users_controller.rb:12:in `show'. Segmentation fault (core dumped). panic: runtime error: invalid memory address or nil pointer dereference
{"error":{"code":404,"message":"Requested entity was not found.","status":"NOT_FOUND"}} {"message":"Internal server error"} {"detail":"Authentication credentials were not provided."}
{"timestamp":"2020-03-01T10:00:00.000+0000","status":500,"error":"Internal Server Error","message":"No message available","path":"/api/v1/items"} {"success":false,"errors":[{"code":1003,"message":"Invalid or missing token"}]}
You need to enable JavaScript to run this app.
JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.
We're sorry but this application doesn't work properly without JavaScript enabled. Please enable it to continue.
For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.
Your browser does not support JavaScript! This website requires JavaScript and it seems to be turned off. Enable JavaScript and cookies to continue.
JavaScript must be enabled in order for you to use this site. However, it seems JavaScript is either disabled or not supported by your browser. To view this content, switch on JavaScript by changing your browser options, then try again.
This browser is no longer supported. Please upgrade to a modern browser to improve your experience. You are using an outdated browser. Sorry, your browser doesn't support embedded videos. Your browser does not support the video tag. Flash plugin required.
Cookies must be enabled to use this site. Your browser has cookies disabled. Make sure your cookies are enabled and try again. This site uses scripts that were blocked. An extension may be blocking parts of this page. It looks like you're using an ad blocker. Please allow ads and refresh.
Loading... Please wait while the content is being loaded. Loading application. If this page does not load, reload it. Redirecting... If you are not redirected automatically, follow this link. You are being redirected.
<noscript>You need to enable JavaScript to use this page.</noscript> <noscript><strong>Scripts are needed to show this content.</strong></noscript>
Fehler 404: Die gewünschte Seite konnte leider nicht gefunden werden. Die von Ihnen aufgerufene Adresse existiert nicht mehr. Möglicherweise wurde die Seite verschoben oder gelöscht. Zurück zur Startseite.
Sie haben keine Berechtigung, auf diese Seite zuzugreifen. Der Zugriff wurde verweigert. Interner Serverfehler. Der Dienst ist vorübergehend nicht verfügbar. Der Server ist überlastet. Es ist ein unerwarteter Fehler aufgetreten. Bitte laden Sie die Seite neu.
Für die Nutzung dieser Website muss JavaScript in Ihrem Browser aktiviert sein. In Ihrem Browser ist JavaScript ausgeschaltet. Bitte schalten Sie JavaScript ein und laden Sie die Seite erneut. Ihr Browser wird nicht unterstützt. Cookies müssen zugelassen werden.
Wegen Wartungsarbeiten steht unser Angebot momentan nicht zur Verfügung. Wir sind in Kürze wieder für Sie da. Ihre Anmeldung ist abgelaufen, bitte melden Sie sich neu an. Zeitüberschreitung bei der Verbindung.
Erreur 404 : la page que vous recherchez est introuvable. Désolé, la page demandée n'existe pas. Elle a peut-être été supprimée ou son adresse a changé. Retour à l'accueil.
Vous n'êtes pas autorisé à accéder à cette page. L'accès vous est interdit. Le serveur a rencontré une erreur interne. Le service est temporairement indisponible. Une erreur inattendue s'est produite, veuillez réessayer ultérieurement. Délai d'attente dépassé.
JavaScript est désactivé dans votre navigateur. Vous devez activer JavaScript pour utiliser ce site. Merci d'autoriser les cookies puis de recharger la page. Votre navigateur n'est pas pris en charge.
Notre site est actuellement en cours de maintenance. Nous serons bientôt de retour. Vous avez été déconnecté, veuillez vous identifier à nouveau. Ce contenu n'est pas accessible dans votre pays.
Error 404: la página que busca no existe. No se ha encontrado la página. Acceso denegado. Active JavaScript en su navegador para continuar. Sitio en mantenimiento. Se ha producido un error inesperado.
क्षमा करें, आप जिस पृष्ठ को ढूंढ रहे हैं वह मौजूद नहीं है। पृष्ठ उपलब्ध नहीं है या हटा दिया गया है। आपको इस पृष्ठ तक पहुँचने की अनुमति नहीं है। कुछ गलत हो गया, कृपया थोड़ी देर बाद फिर से प्रयास करें। सर्वर में त्रुटि हुई है।
इस साइट का उपयोग करने के लिए अपने ब्राउज़र में JavaScript सक्षम करें। आपके ब्राउज़र में जावास्क्रिप्ट बंद है। कृपया कुकीज़ सक्षम करें और पृष्ठ फिर से लोड करें। रखरखाव के कारण साइट अभी बंद है। आपका सत्र समाप्त हो गया है, कृपया दोबारा लॉग इन करें।
Ошибка 404. Страница не найдена. Запрашиваемая страница не существует или была удалена. Доступ запрещён. Сервис временно недоступен, попробуйте позже. Для работы с сайтом включите JavaScript в настройках браузера. Произошла непредвиденная ошибка.
ಪುಟ ಕಂಡುಬಂದಿಲ್ಲ. ದಯವಿಟ್ಟು ನಿಮ್ಮ ಬ್ರೌಸರ್‌ನಲ್ಲಿ JavaScript ಸಕ್ರಿಯಗೊಳಿಸಿ. ಏನೋ ತಪ್ಪಾಗಿದೆ, ನಂತರ ಪ್ರಯತ್ನಿಸಿ. పేజీ కనుగొనబడలేదు. దయచేసి మీ బ్రౌజర్‌లో JavaScript ప్రారంభించండి. ఏదో తప్పు జరిగింది, తర్వాత ప్రయత్నించండి.
""".strip()

# Leftover markup and values that were never filled in.
MARKUP = """
[object Object] undefined null NaN NaN% undefined undefined null null [object Object],[object Object] Invalid Date NaN:NaN undefined/undefined
<?php get_footer(); ?> <?php if (have_posts()) : while (have_posts()) : the_post(); ?> <?= $this->title ?> <?xml version="1.0" encoding="utf-8"?>
{{#each items}} {{this.name}} {{/each}} {{> header}} {% extends "base.html" %} {% block content %}{% endblock %} {%- if page.title -%} {%- endif -%} <%= yield %> <%= render partial %> ${title} #{name}
[vc_row][vc_column][vc_column_text][/vc_column_text][/vc_column][/vc_row] [gallery columns="3"] [contact-form-7 id="12"] [et_pb_section][/et_pb_section] [/caption] [embed] [audio mp3=""][/audio]
<!-- wp:paragraph --> <!-- /wp:paragraph --> <!-- BEGIN HEADER --> <!-- end .entry-content --> <div class="container"><div class="row"></div></div> <span></span> <p>&nbsp;</p> <br /><br /> </td></tr></table>
&nbsp;&nbsp;&nbsp; &amp;amp; &lt;br&gt; &quot;&quot; &#160; &#8217; &raquo; &laquo; %s %d %1$s of %2$s %d items found. Showing %s to %s of %s entries. {0} of {1}. Page {0}.
""".strip()

# Entries of menus and lines around a page's content.
NAVIGATION = """
Home | About | Services | Blog
Home About us Products Services Blog
News Sport Weather Culture Business Opinion
Home / Archive / Article
Home > Category > Page
Toggle navigation Menu Close
Jump to navigation Jump to search
Skip navigation
Search for: Search
Sign in Create account Register Log out My account
Subscribe to our newsletter RSS feed
Facebook Twitter Instagram YouTube LinkedIn
Share this: Print Email Tweet
Previous post Next post Older Newer
Return to homepage Go back Top of page
Recent posts Categories Archives Tags
Terms of service Privacy notice Cookie policy Imprint Accessibility Sitemap
Advertise with us Careers Help FAQ
© All rights reserved. Copyright
Powered by
""".strip()

# Natural text of the public domain, so that tables of a few rows have some to compare with.
NATURAL = """
All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude.
Alice was beginning to get very tired of sitting by her sister on the bank, and of having nothing to do: once or twice she had peeped into the book her sister was reading, but it had no pictures or conversations in it, and what is the use of a book, thought Alice, without pictures or conversations? So she was considering in her own mind, as well as she could, for the hot day made her feel very sleepy and stupid, whether the pleasure of making a daisy-chain would be worth the trouble of getting up and picking the daisies.
It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness, it was the epoch of belief, it was the epoch of incredulity, it was the season of Light, it was the season of Darkness, it was the spring of hope, it was the winter of despair.
Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, and nothing particular to interest me on shore, I thought I would sail about a little and see the watery part of the world. It is a way I have of driving off the spleen and regulating the circulation.
It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife. However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families, that he is considered the rightful property of some one or other of their daughters.
Four score and seven years ago our fathers brought forth on this continent, a new nation, conceived in Liberty, and dedicated to the proposition that all men are created equal. Now we are engaged in a great civil war, testing whether that nation, or any nation so conceived and so dedicated, can long endure. We are met on a great battle-field of that war.
To Sherlock Holmes she is always the woman. I have seldom heard him mention her under any other name. In his eyes she eclipses and predominates the whole of her sex. It was not that he felt any emotion akin to love for her. All emotions, and that one particularly, were abhorrent to his cold, precise but admirably balanced mind.
Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person.
Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.
Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.
सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।
Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.
""".strip()
