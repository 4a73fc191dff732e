"""Texts from which byte models of charsets are fitted: the first article of the Universal Declaration of Human Rights in each
language, and common words of it.  Fixed values, as published; the models are computed from them."""

from __future__ import annotations

#: Of each language, a text.
TEXTS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just those people too little state good very make world still see own work men day get here between both being under three never know last same another while us might great since against go came right used take three café naïve résumé",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. "
    "été où être même après très déjà là à ça ces était français première années président société général création sécurité système modèle problème également façon garçon reçu "
    "intérêt hôtel côté contrôle forêt août connaître naïf noël cœur sœur œuvre élève mère père frère étudiant économie région qualité développé prévu numéro téléphone télécharger paramètres "
    "créer fenêtre détails réseau échec évité supprimé enregistré précédent caractères impossible d’écrire l’élément n’est pas déjà utilisé répertoire réponse çà voilà lumière légère grève",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. "
    "für über können müssen möglich größe groß straße schön früh später während hätte wäre würde natürlich weiß heißt außer dürfen öffnen löschen ändern geändert gültig ungültig verfügbar "
    "zurück länge höhe prüfen schlüssel ausführen einfügen bestätigen gehört fünf zwölf öffentlich österreich mädchen bäume häuser füße grüße gemäß ließ muß daß schließen überprüfung übersetzung für die grün tür",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. "
    "más también está años según así día días país después información sólo aquí nación región año español niño niña señor mañana sesión acción dirección versión opción página número código línea "
    "contraseña tamaño área último través política económico público rápido difícil fácil árbol música café él sí qué cómo cuándo dónde quién además todavía había tenía sería podría pequeño compañía españa ¿qué? ¡sí! corazón canción índice búsqueda pingüino",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. "
    "não são também está até você já então há só português informação opção versão função ação configuração seleção coração irmão mão pão nação órgão público área número código página línguas três mês "
    "após é às à ser possível inválido válido início usuário memória diretório necessário próximo último máximo mínimo avançado serviço endereço preço força começar atenção três avó avô pôr têm vêm será poderá lá cá pés",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. "
    "è più perché città già così può però qualità università attività società verità libertà sarà farà là lì giù né sì ciò virtù lunedì martedì venerdì modalità possibilità età metà papà caffè cioè finché poiché è stato impossibile aprire il file valore non valido riga numero messaggio uscita ingresso dimensione connessione cambiato rimosso installa aggiorna stato sconosciuto settimana mese anno parole qui come da a su meno primo deve essere usare solo se ogni specificato o non riuscito gli le una con per del della l'opzione dell'elenco un'altra c'è",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. "
    "på för från när där här så två år även också många måste är får någon något några år stå gå då små större först själv känd större lösenord använda användare öppna ändra läsa språk sökväg värde nästa försök åtgärd fönster över både få började Åke ö å ä",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. "
    "på for når være også må så år få går før første større øst sø ø æ å været både når kører åbne ændre læse fejl størrelse nøgle ønsker gør bør spørgsmål værdi indstillinger første længde ændringer små blå hår mål æble søge måned København også kan ikke åbne filen ugyldig værdi linje nummer meddelelse uddata inddata forbindelse ændret fjernet installere opdatere tilstand ukendt uge måned ord her hvad hvordan fra til om mere mindre første største skal bruge kun hvis hver angivet dansk eller mislykkedes og det som en af den er et de med",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. "
    "på når være også må så år få går før første større været både åpne lese feil størrelse nøkkel ønsker gjør bør spørsmål språk søk måned mål små blå ikke får følge høy låst øverst nåværende tilgjengelig ærlig kan ikke åpne filen ugyldig verdi linje nummer melding utdata inndata tilkobling endret fjernet installere oppdatere tilstand ukjent uke måned ord her hva hvordan fra til om mer mindre første største må bruke bare hvis hver angitt norsk eller mislyktes og det som en av den er et de med",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    "tämä että myös sitä hän kään ettei jälkeen mitä näin pitää yhtä käyttää käyttäjä hyvä päivä työ äiti vielä enää tässä välillä näytä lisää määrä säännöt epäonnistui pyyntö päällä syötä löydy älä yö ei voi",
    "is": "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku, og ber þeim að breyta bróðurlega hverjum við annan. "
    "það er ekki við þetta þessi því þú ég hún hann sér frá fyrir þegar síðan með árið öll orð góður maðurinn ísland íslenska æ ð þ ó ú",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. één geïnstalleerd coördinatie ideeën reünie financiële categorieën beëindigen vóór geëxporteerd knieën zeeën patiënten België kan bestand niet openen ongeldige waarde regel nummer bericht uitvoer invoer grootte verbinding gewijzigd verwijderd installeren bijwerken toestand onbekend week maand jaar woorden hier wat hoe van naar over meer minder eerste grootste moet gebruiken alleen als elke opgegeven nederlands of mislukt het een de en is dat",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. més també això què és està només aquí informació opció versió adreça però català països qüestió raó línia fàcil número pàgina següent vàlid però col·lecció canvi açò així no es pot obrir el fitxer valor no vàlid línia número missatge sortida entrada mida connexió canviat suprimit instal·la actualitza estat desconegut setmana mes any paraules aquí com de a sobre menys primer més gran ha de ser utilitza si cada especificat o ha fallat els les una amb per",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    "się nie że jest są był było więc także może można który które której które będzie również już też przez tę tą ją swój dzień tydzień miesiąc życie świat człowiek państwo część żeby jeśli gdzie wszystko użytkownik hasło "
    "błąd plików katalog usunąć dodać zmienić został można długość źródło właściwości wartość następny otwórz wyjście połączenie łódź źdźbło śnieg żółty gęś pięć sześć dziewięć książka ręka mąż żona ćwierć ósmy góra ból mówić święto nie można otworzyć nieprawidłowa wiersz liczba komunikat wyjście wejście rozmiar połączenie zmieniono usunięto zainstalować zaktualizować stan nieznany tydzień miesiąc rok słowa tutaj co jak z do o mniej pierwszy największy musi użyć tylko jeśli każdy podany polski lub nie powiodło się",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. "
    "že je se na není byl byla bylo jsou který která které může být více také při před již když až svůj město země život člověk děti září květen říjen středa úterý čtvrtek pátek soubor složka uložit otevřít zavřít chyba "
    "uživatel heslo změnit výběr nastavení délka hodnota následující předchozí žádný každý příliš žluťoučký kůň úpěl ďábelské ódy řeka tři čtyři pět šest dítě něco někdo proč kde až přítel můj dům stůl ještě přes nelze otevřít neplatná řádek číslo zpráva výstup vstup velikost připojení změněno odstraněno instalovat aktualizovat stav neznámý týden měsíc rok slova zde jak z do o méně první největší musí použít pouze pokud každé zadaný čeština nebo nepodařilo",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu. "
    "že je sa nie bol bola bolo sú ktorý ktorá ktoré môže byť viac tiež pri pred už keď až svoj mesto život človek deti súbor uložiť otvoriť chyba používateľ heslo zmeniť výber nastavenie dĺžka hodnota nasledujúci žiadny každý ľad ňou ťažký kôň stĺp vŕba päť deväť mäso nemožno otvoriť súbor neplatná hodnota riadok číslo správa výstup vstup veľkosť pripojenie zmenené odstránené inštalovať aktualizovať stav neznámy týždeň mesiac rok slová tu čo ako z do o viac menej prvý najväčší musí byť použiť iba ak každý zadaný slovenčina alebo nepodarilo sa",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. "
    "és hogy nem egy volt már még csak így úgy után előtt között több első új később ő őket idő nő fő két három négy öt hét nyolc kilenc tíz év hónap ország város könyv fájl könyvtár törlés mentés megnyitás hiba felhasználó jelszó "
    "módosítás beállítások hossz érték következő előző érvénytelen művelet sikertelen létre kép szöveg űrlap tűz víz föld erdő sűrű gyűjtemény árvíztűrő tükörfúrógép szükséges elérhető",
    "ro": "Toate fiinţele umane se nasc libere şi egale în demnitate şi în drepturi. Ele sunt înzestrate cu raţiune şi conştiinţă şi trebuie să se comporte unele faţă de altele în spiritul fraternităţii. "
    "şi în că să este nu mai după când până două această acest către fără între încă aşa astăzi oraş ţară viaţă fişier director utilizator parolă eroare ştergere adăugare mărime informaţii opţiuni acţiune următor înapoi închide găsit român pâine câine mână sau nu poate fi deschis valoare nevalidă fişierul linia număr mesaj ieşire intrare dimensiune conexiune schimbat şters instalare actualizare stare necunoscut săptămână lună an cuvinte aici ce cum din spre despre mai mult puţin primul cel mare trebuie folosit numai dacă fiecare specificat aceasta această va vă rugăm eşuat afişează însă atât în timp ce nici un",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. "
    "što je nije više već također će će još može moći između ako kako gdje ništa žena čovjek kuća grad država riječ tisuća veličina datoteka pogreška lozinka postavke sljedeći prethodni otvoriti učitaj svjetski šest četiri džep đak i je u na za da se su koji nije može biti od do ili ali pa kada kako bi bilo bila bio sam si ima potrebno korisnik nevažeća vrijednost nije moguće spremiti izbriši promijeni naziv sve također ažuriranje uključi isključi očekivan određeni ispiši broj retka način pogrešno privremeno hrvatski područje želite izvješće pokušaj događaj poništi rješenje",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. če že še kot več tudi lahko človek življenje mesto država šola čas časa možno končati začetek pošlji naslednji največji in je v na za da se so ki ni bo pri po iz od do ali pa kar ko če bi bilo bila bil sem si ima lahko potrebno uporabnik geslo napaka datoteke mape ni mogoče odpreti shrani izbriši spremeni vrednost neveljavna možnosti različica prikaži ime vse žal že čez všeč pošta sporočilo povezava vključi izključi pričakovan določi izpiši številka vrstice način napačno uporabljen naključno začasno slovenščina območje",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. "
    "bir ve bu için çok daha değil olduğu olarak sonra kadar gibi ancak şey şimdi çünkü güzel büyük küçük gün yıl kişi dünya ülke şehir İstanbul Türkiye Türkçe İngilizce dosya dizin kullanıcı şifre hata geçersiz değiştir sil aç kapat "
    "yükle gönder ağ bağlantı öğe seçenek görüntüle yazdır sayfa başlat çalıştır üzerinde altında içinde değer uzunluğu bulunamadı oluşturuldu ışık sıcak yılı kız oğlan ağaç dağ soğuk yağmur hiçbir göster dosya açılamadı geçersiz değer satır sayı ileti çıktı girdi boyut bağlantı değişti silindi kur güncelle durum bilinmeyen hafta ay yıl sözcük burada ne nasıl daha az ilk en büyük olmalı kullan yalnızca eğer her belirtilen veya başarısız oldu",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. või ka mõned ära üks kõige pärast õige täna päev öö töö küll saab võib väga aeg jõgi šokolaad žürii vigane väärtus faili ei leitud ebaõnnestus loomine peab olema kasutada ainult kui iga määratud rida arv teade väljund sisend suurus ühendus muudetud eemaldatud paigaldada uuendada olek tundmatu nädal kuu aasta sõnad siin mida kuidas rohkem vähem esimene suurim eesti keel",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. ir un ka tā nav kā šis vēl pēc bija būs tiek jūs mēs viņš kļūda lietotājs parole fails mape atvērt saglabāt izdzēst vārds nākamais iepriekšējais ļoti ģimene ķīna šķērsot žurnāls nederīga vērtība datni nevar atrast neizdevās izveidot jābūt lietot var tikai ja vai katrs norādīts rinda skaitlis ziņojums izvades ievades izmērs savienojums mainīts noņemts instalēt atjaunināt stāvoklis nezināms nedēļa mēnesis gads vārdi šeit ko kā no uz par vairāk mazāk pirmais lielākais latviešu valoda jā nē kāds pieejams tādēļ šādi",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. yra ir kad tai nėra šis dar po buvo bus jūs mes įvesti žodis klaida naudotojas slaptažodis failas aplankas atverti įrašyti pašalinti kitas ankstesnis labai šeima žmogus gražus ąžuolas ėjo ūkis visų neteisinga reikšmė failo negalima rasti nepavyko sukurti įvyko klaidų turi būti naudoti galima tik jei arba kai kurie kiekvienas šią parinktį nurodytas eilutė skaičius pranešimas išvesties įvesties dydis ryšys keičiama pašalinta įdiegti atnaujinti būsena nežinomas savaitė mėnuo metų žodžiai čia ką kaip iš į už apie daugiau mažiau pirmas didžiausias reikėtų privalo ši šios jų jį",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
    "и в не на что я с он как это по но они мы она так из у за вы же от все её было только уже для или быть был его до при ещё если когда можно время год люди человек жизнь день рука раз работа слово место вопрос лицо друг дело "
    "файл каталог ошибка пароль пользователь открыть сохранить удалить изменить текст который поисковая система читает русский язык сегодня хорошо объект подъезд чтобы также является эта этот между через первый большой",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. "
    "і в не на що я з він як це по але вони ми вона так із у за ви від все її було тільки вже для або бути був його до при ще якщо коли можна час рік люди людина життя день Україна її є ґрунт файл помилка пароль користувач відкрити зберегти видалити змінити українська мова",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. и в не на че се с той как това по но те ние тя така от за са все още беше само вече или да бъде бил до при ако когато време година хора човек живот ден файл грешка парола потребител български език това към през между първи",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. "
    "και το να του η της με που την από για είναι στο θα τα μας σας αυτό δεν τον ότι ένα μια σε ή όμως όπως πολύ πρέπει μόνο αλλά πριν μετά χρόνια ώρα ημέρα αρχείο φάκελος σφάλμα κωδικός χρήστης άνοιγμα αποθήκευση διαγραφή Ελλάδα ελληνικά κείμενο αναζήτηση Αθήνα Άγιος ύψος ήταν",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. של את על לא זה הוא היא עם כי גם אם או אני כל יש אין היה מה לפני אחרי יותר רק אבל כאשר שנה יום עולם ישראל עברית קובץ תיקייה שגיאה סיסמה משתמש פתח שמור מחק טקסט חיפוש שלום בית ספר ילד אדם לא ניתן לפתוח את הקובץ ערך שגוי שורה מספר הודעה פלט קלט גודל חיבור השתנה הוסר התקנה עדכון מצב לא ידוע שבוע חודש מילים כאן איך כמו מן אל עוד פחות ראשון גדול חייב להיות להשתמש רק אם כדי כל אחת שימוש אפשרויות תוכנית אזהרה אין אפשרות מערכת שם",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. في من على إلى أن هذا هذه التي الذي كان لا ما هو هي مع عن كل بعد قبل بين أو ثم قد لم عند حتى يوم سنة العالم الناس مدينة ملف مجلد خطأ كلمة المرور مستخدم فتح حفظ حذف نص اللغة العربية بحث سلام بيت كتاب، ؟ إذا أكثر",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ที่ และ ใน เป็น ของ มี ได้ ว่า ไม่ จะ ให้ กับ จาก นี้ ไป มา คน วัน ปี แฟ้ม ผิดพลาด รหัสผ่าน ผู้ใช้ เปิด บันทึก ลบ ข้อความ ภาษาไทย ค้นหา สำหรับ อยู่ แล้ว ก็ ต้อง การ ความ หรือ เพื่อ",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. không có là của và được cho một những người trong với này đã các để khi đến từ cũng như lại nhiều tập tin thư mục lỗi mật khẩu người dùng mở lưu xoá tiếng Việt năm ngày",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。これはそれがのにをでとてしたするいるあるなったことものからまでよりですますないという日本語の文章です。検索エンジンはテキストを読みます。ファイルを開くことができません。ユーザーのパスワードが正しくありません。お願いします。ありがとうございます。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 이 것은 있는 수 하는 그 등 및 있습니다 합니다 입니다 파일을 열 수 없습니다 사용자 암호가 올바르지 않습니다 한국어 문장 검색 텍스트를 읽습니다",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运",
    "tw": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作里用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日軍者意無力它與長把機十民第公此已工使情明性知全三又關點正業外將兩高間由問很最重並物手應戰向頭文體政美相見被利什二等產或新己制身果加西斯月話合回特代內信表化老給世位次度門任常先海通教兒原東聲提立及比員解水名真論處走義各入幾口認條平系氣題活爾更別打女變四神總何電數安少報才結反受目太量再感建務做接必場件計管期市直德資命山金指克許統區保至隊形社便空決治展馬科司五基眼書非則聽白卻界達光放強即像難且權思王象完設式色路記南品住告類求據程",
}
