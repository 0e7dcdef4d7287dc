"""Vocabularies and enumerations that results must agree on."""

# Fixed values throughout this module; order matters where a comment says so.

#: Spellings of editions and their labels; the first that matches names the edition.
EDITIONS = [
    (r"(?:^|[ ._\-\[(])(Director(?:.?s)?[ ._-]?(?:Cut|Edition|Version)|DC(?=$|[ ._-])|\x{5BFC}\x{6F14}\x{526A}\x{8F91}\x{7248}|\x{5C0E}\x{6F14}\x{526A}\x{8F2F}\x{7248})(?:$|[^A-Za-z])", "Director's Cut"),
    (r"(?:^|[ ._\-\[(])(Final[ ._-]?Cut)(?:$|[^A-Za-z])", "Final Cut"),
    (r"(?:^|[ ._\-\[(])(Extended(?:[ ._-]?(?:Cut|Edition|Version))?|EXT(?=$|[ ._-]))(?:$|[^A-Za-z])", "Extended"),
    (r"(?:^|[ ._\-\[(])((?:Deutsche|Italienische)?[ ._-]?Langfassung|Version[ ._-]?Longue|Vers\x{00E3}o[ ._-]?Estendida)(?:$|[^A-Za-z])", "Extended"),
    (r"(?:^|[ ._\-\[(])(Super[ ._-]?Duper[ ._-]?Cut|Expanded(?:[ ._-]?Edition)?)(?:$|[^A-Za-z])", "Extended"),
    (r"(?:^|[ ._\-\[(])(IMAX(?:[ ._-]?Enhanced)?)(?:$|[^A-Za-z])", "IMAX"),
    (r"(?:^|[ ._\-\[(])(Redux)(?:$|[^A-Za-z])", "Redux"),
    (r"(?:^|[ ._\-\[(])(Theatrical(?:[ ._-]?Cut)?)(?:$|[^A-Za-z])", "Theatrical"),
    (r"(?:^|[ ._\-\[(])((?:Deutsche)?[ ._-]?Kinofassung|Theactrical)(?:$|[^A-Za-z])", "Theatrical"),
    (r"(?:^|[ ._\-\[(])(Uncut|UC)(?:$|[^A-Za-z])", "Uncut"),
    (r"(?:^|[^A-Za-z0-9])(\x{5E74}\x{9F61}\x{9650}\x{5236}\x{7248}|\x{5E74}\x{9F84}\x{9650}\x{5236}\x{7248})(?:$|[^A-Za-z])", "Uncut"),
    (r"(?:^|[ ._\-\[(])(Unrated)(?:$|[^A-Za-z])", "Unrated"),
    (r"(?:^|[ ._\-\[(])(Remaster(?:ed)?)(?:$|[^A-Za-z])", "Remastered"),
    (r"(?:^|[ ._\-\[(])(Remasterizado|Color[ ._-]?Corrected|\x{9AD8}\x{6E05}\x{4FEE}\x{590D}\x{7248})(?:$|[^A-Za-z])", "Remastered"),
    (r"(?:^|[ ._\-\[(])(?<!AI[ ._-])(RM(?=$|[ ._-])|REMAST(?=$|[ ._-])|Enhanced|New[ ._-]?Transfer|Transfer|Arrow(?:[ ._-]?Video)?)(?:$|[^A-Za-z])", "Remastered"),
    (r"(?:^|[ ._\-\[(])(Criterion(?:[ ._-]?Collection)?|CC)(?:$|[^A-Za-z])", "Criterion"),
    (r"(?:^|[ ._\-\[(])(Open[ ._-]?Matte)(?:$|[^A-Za-z])", "Open Matte"),
    (r"(?:^|[ ._\-\[(])(Censored)(?:$|[^A-Za-z])", "Censored"),
    (r"(?:^|[^A-Za-z0-9])(\x{6709}\x{7801}|\x{6709}\x{78BC}|\x{30E2}\x{30B6}\x{30A4}\x{30AF}\x{6709})(?:$|[^A-Za-z])", "Censored"),
    (r"(?:^|[ ._\-\[(])(Uncensored)(?:$|[^A-Za-z])", "Uncensored"),
    (r"(?:^|[ ._\-\[(])(\x{7121}\x{4FEE}\x{6B63})(?:$|[^A-Za-z])", "Uncensored"),
    (r"(?:^|[ ._\-\[(])(iNTERNAL|INTERNAL|iNT)(?:$|[^A-Za-z])", "Internal"),
    (r"(?:^|[ ._\-\[(])(LIMITED)(?:$|[^A-Za-z])", "Limited"),
    (r"(?:^|[ ._\-\[(])(UNTOUCHED)(?:$|[^A-Za-z])", "Untouched"),
    (r"(?:^|[ ._\-\[(])(DIRFIX|NFOFIX)(?:$|[^A-Za-z])", "Dirfix"),
    (r"(?:^|[^A-Za-z0-9])(\x{521D}\x{56DE}\x{9650}\x{5B9A}\x{7248}|\x{521D}\x{56DE}\x{9650}\x{5B9A}\x{76E4}|\x{521D}\x{56DE}\x{7248})(?:$|[^A-Za-z])", "Limited"),
    (r"(?:^|[ ._\-\[(])(CUSTOM)(?:$|[^A-Za-z])", "Custom"),
    (r"(?:^|[ ._\-\[(])(WS|WIDESCREEN)(?:$|[^A-Za-z])", "Widescreen"),
    (r"(?:^|[ ._\-\[(])(RETAIL)(?:$|[^A-Za-z])", "Retail"),
    (r"(?:^|[ ._\-\[(])(UNCEN|UNC|UNCENSOR|UNSENCORED|UNCESORED|Non[ ._-]?Censur\x{00E9}|Sin[ ._-]?Censura|Sem[ ._-]?Censura|Decensored)(?:$|[^A-Za-z])", "Uncensored"),
    (r"(?:^|[^A-Za-z0-9])(\x{65E0}\x{7801}\x{6D41}\x{51FA}|\x{7121}\x{78BC}\x{6D41}\x{51FA}|\x{30E2}\x{30B6}\x{30A4}\x{30AF}\x{7834}\x{58CA}\x{7248}|\x{65E0}\x{7801}|\x{7121}\x{78BC})(?:$|[^A-Za-z])", "Uncensored"),
    (r"(?:^|[ ._\-\[(])(Collector.?s[ ._-]?Edition|COLLECTORS?|CE)(?:$|[^A-Za-z])", "Collector"),
    (r"(\x{FF24}\x{FF2C}\x{7248}|DL\x{7248}|\x{30C0}\x{30A6}\x{30F3}\x{30ED}\x{30FC}\x{30C9}\x{7248})", "Download"),
    (r"(\x{30D1}\x{30C3}\x{30B1}\x{30FC}\x{30B8}\x{7248}|\x{30BB}\x{30EB}\x{7248})", "Retail"),
    (r"(?:^|[ ._\-\[(])(Special[ ._-]?Edition|SE(?=$|[ ._-]))(?:$|[^A-Za-z])", "Special Edition"),
    (r"(?:^|[ ._\-\[(])((?:Memorial|Premium|Legacy|Platinum|Definitive|Gold)[ ._-]?Edition|Ilustrado)(?:$|[^A-Za-z])", "Special Edition"),
    (r"(?:^|[^A-Za-z0-9])(\x{30C7}\x{30B8}\x{30BF}\x{30EB}\x{7279}\x{88C5}\x{7248}|\x{7279}\x{88C5}\x{7248})", "Special Edition"),
    (r"(?:^|[ ._\-\[(])(Deluxe(?:[ ._-]?Edition)?|\x{8C6A}\x{83EF}\x{7248}|\x{8C6A}\x{534E}\x{7248})(?:$|[^A-Za-z])", "Deluxe"),
    (r"(?:^|[ ._\-\[(])(Despecialized)(?:$|[^A-Za-z])", "Despecialized"),
    (r"(?:^|[ ._\-\[(])(Assembly[ ._-]?Cut)(?:$|[^A-Za-z])", "Assembly Cut"),
    (r"(?:^|[ ._\-\[(])((?:\d{1,3}(?:th|st|nd|rd)[ ._-]?)?Anniversary[ ._-]?Edition)(?:$|[^A-Za-z])", "Anniversary"),
    (r"(?:^|[ ._\-\[(])(Signature[ ._-]?Edition)(?:$|[^A-Za-z])", "Signature"),
    (r"(?:^|[ ._\-\[(])(Imperial[ ._-]?Edition)(?:$|[^A-Za-z])", "Imperial"),
    (r"(?:^|[ ._\-\[(])(Diamond[ ._-]?Edition)(?:$|[^A-Za-z])", "Diamond"),
    (r"(?:^|[ ._\-\[(])(2[ ._-]?in[ ._-]?1)(?:$|[^A-Za-z0-9])", "2in1"),
    (r"(?:^|[ ._\-\[(])(Pre[ ._-]?Air)(?:$|[^A-Za-z])", "Preair"),
    (r"(?:^|[ ._\-\[(])(FINAL)(?![ ._-]?Cut)(?:$|[^A-Za-z])", "Final"),
    (r"(?:^|[ ._\-\[(])(Original(?:[ ._-]?(?:Version|Cut))?|Originalfassung|Org[ ._-]?Vers|\x{539F}\x{7248})(?:$|[^A-Za-z])", "Original"),
    (r"(?:^|[ ._\-\[(])((?:Proof|Sync|Rar|Sample|Crack|Proper)?Fix(?:ed)?|PROOF|Corrected|Corregido|Updated|\x{4FEE}\x{6B63}\x{7248})(?:$|[^A-Za-z])", "Fix"),
    (r"(?:^|[ ._\-\[(])(Complete[ ._-]?Edition|\x{5B8C}\x{5168}\x{7248}|\x{5B8C}\x{6574}\x{7248})(?:$|[^A-Za-z])", "Complete Edition"),
    (r"(?:^|[ ._\-\[(])(Unabridged)(?:$|[^A-Za-z])", "Unabridged"),
    (r"(?:^|[ ._\-\[(])(Convert|Re[ ._-]?Enc(?:ode[d]?)?|Remake)(?:$|[^A-Za-z])", "Re-encode"),
    (r"(?:^|[ ._\-\[(])(\d{1,2}ed(?=$|[ ._-])|\d{1,3}(?:st|nd|rd|th)[ ._-]?Edition)(?:$|[^A-Za-z])", "Numbered Edition"),
    (r"(?:^|[ ._\-\[(])((?:USA?|UK|Japan(?:ese)?|Asian|Hong[ ._-]?Kong)[ ._-]?(?:Ver(?:sion)?|Edition|Cut)|(?:Amerikanische|Japanische|Internationale)[ ._-]?Fassung|International[ ._-]?(?:Cut|Version)|\x{7F8E}\x{7248}|\x{5317}\x{7C73}\x{7248})(?:$|[^A-Za-z])", "Regional"),
    (r"(?:^|[^A-Za-z0-9])(Hi[ ._-]?Res|\x{9AD8}\x{7801}\x{7248}|60\x{5E27}\x{7387}\x{7248}\x{672C}|\x{9AD8}\x{6E05}\x{7248})(?:$|[^A-Za-z])", "High Quality"),
    (r"(?:^|[ ._\-\[(])(Ultimate(?:[ ._-]?(?:Edition|Cut))?)(?:$|[^A-Za-z])", "Ultimate"),
    (r"(?:^|[ ._\-\[(])(Fan[ ._-]?Edit(?:ion)?|Fan[ ._-]?Collection)(?:$|[^A-Za-z])", "Fan Edit"),
    (r"(?:^|[ ._\-\[(])(Bootleg|Soundboard)(?:$|[^A-Za-z])", "Bootleg"),
    (r"(?:^|[ ._\-\[(])(Unofficial(?:[ ._-]?Batch)?)(?:$|[^A-Za-z])", "Unofficial"),
    (r"(?:^|[ ._\-\[(])(BONUS(?:[ ._-]?(?:Disc|DVD|CD|Material))?|Extras?[ ._-]?Disc|EXTRA(?=$|[ ._-]))(?:$|[^A-Za-z])", "Bonus"),
    (r"(?:^|[ ._\-\[(])(Festival)(?:$|[^A-Za-z])", "Festival"),
    (r"(?:^|[ ._\-\[(])(Alternat(?:e|ive)[ ._-]?(?:\w+[ ._-])?(?:Cut|Version|Edit)|Alt[ ._-]?Cut|Remix|Edited|Re[ ._-]?Cut|Recut|Re[ ._-]?Edit(?:ed)?)(?:$|[^A-Za-z])", "Alternate Cut"),
    (r"(?:^|[^A-Za-z0-9])(\x{5225}\x{7248})", "Alternate Cut"),
    (r"(?:^|[ ._\-\[(])(Shortened|Kurzfassung)(?:$|[^A-Za-z])", "Shortened"),
    (r"(?:^|[ ._\-\[(])(Leaked|Leak)(?:$|[^A-Za-z])", "Leaked"),
    (r"(?:^|[^A-Za-z0-9])(\x{901A}\x{5E38}\x{7248}|\x{6A19}\x{6E96}\x{7248}|\x{6807}\x{51C6}\x{7248})(?:$|[^A-Za-z])", "Standard"),
    (r"(?:^|[ ._\-\[(])(Standard[ ._-]?(?:Edition|Version))(?:$|[^A-Za-z])", "Standard"),
    (r"(?:^|[ ._\-\[(])(Creditless|Textless|NC(?:OP|ED)\d?)(?:$|[^A-Za-z])", "Creditless"),
    (r"(?:^|[ ._\-\[(])(Taylor.?s[ ._-]?Version|Re[ ._-]?Recorded)(?:$|[^A-Za-z])", "Re-recorded"),
    (r"(?:^|[ ._\-\[(])((?:Cast|Director.?s|Audio)?[ ._-]?Commentary(?:[ ._-]?Edition)?)(?:$|[^A-Za-z])", "Commentary"),
    (r"(?:^|[ ._\-\[(])(Explicit(?:[ ._-]?Version)?)(?:$|[^A-Za-z])", "Explicit"),
    (r"(?:^|[ ._\-\[(])(Reissue|Re[ ._-]Issue)(?:$|[^A-Za-z])", "Reissue"),
    (r"(?:^|[ ._\-\[(])(OAR|Original[ ._-]?Aspect[ ._-]?Ratio)(?:$|[^A-Za-z])", "Original Aspect Ratio"),
    (r"(?:^|[ ._\-\[(])(Restored|Restoration|Restaurierte[ ._-]?Fassung|Regraded|Re[ ._-]?Grade)(?:$|[^A-Za-z])", "Restored"),
    (r"(?:^|[ ._\-\[(])(Colou?rized|Colou?rised|In[ ._-]?Colou?r)(?:$|[^A-Za-z])", "Colorized"),
    (r"(?:^|[^A-Za-z0-9])(\x{30AB}\x{30E9}\x{30FC}\x{5316}|\x{30D5}\x{30EB}\x{30AB}\x{30E9}\x{30FC}\x{7248})", "Colorized"),
    (r"(?:^|[ ._\-\[(])(FS|FULLSCREEN|Full[ ._-]?Screen)(?:$|[^A-Za-z])", "Fullscreen"),
    (r"(?:^|[ ._\-\[(])([2-9][ ._-]?(?:DISC|DVD)S?|Multi[ ._-]?Disc)(?:$|[^A-Za-z])", "Multi-Disc"),
]

#: Labels of editions by id, from 1; the smallest id is the primary edition.
EDITION_LABELS = [
    "IMAX",
    "Criterion",
    "Open Matte",
    "Remastered",
    "Unrated",
    "Uncut",
    "Uncensored",
    "Special Edition",
    "Deluxe",
    "Redux",
    "Extended",
    "Director's Cut",
    "Final Cut",
    "Theatrical",
    "Despecialized",
    "Assembly Cut",
    "Anniversary",
    "Signature",
    "Imperial",
    "Diamond",
    "2in1",
    "Preair",
    "Internal",
    "Limited",
    "Untouched",
    "Dirfix",
    "Custom",
    "Widescreen",
    "Download",
    "Retail",
    "Collector",
    "Final",
    "Original",
    "Fix",
    "Complete Edition",
    "Unabridged",
    "Re-encode",
    "Numbered Edition",
    "Regional",
    "High Quality",
    "Ultimate",
    "Censored",
    "Fan Edit",
    "Bootleg",
    "Unofficial",
    "Bonus",
    "Festival",
    "Multi-Disc",
    "Alternate Cut",
    "Shortened",
    "Leaked",
    "Colorized",
    "Fullscreen",
    "Standard",
    "Creditless",
    "Re-recorded",
    "Commentary",
    "Explicit",
    "Reissue",
    "Original Aspect Ratio",
    "Restored",
]

#: Spellings of languages and their ISO 639-3 codes; every row that matches counts, in this order.
LANGUAGES = [
    (r"EN|ENG|ENGLISH|INGLES|ING", "eng"),
    (r"EN[ ._-]?US|EN[ ._-]?GB|ENGLISHMTL|VOSTEN", "eng"),
    (r"JPN|JAP|JA|JAPANESE|JP", "jpn"),
    (r"GER|DEU|GERMAN|DEUTSCH", "deu"),
    (r"DE", "deu"),
    (r"ITA|ITALIAN|ITALIANO|IT", "ita"),
    (r"FRE|FRA|FRENCH|TRUEFRENCH|VOSTFR|VFF|VFI|VFQ", "fra"),
    (r"FR|VF|FRANCAIS|FRAN\x{00C7}AIS", "fra"),
    (r"SPA|ESP|SPANISH|CASTELLANO|LATINO|ESPANOL|ESPA\x{00D1}OL|LATIN|LATI|LATINOAMERICANO", "spa"),
    (r"ES|ES[ ._-]?LA|SPA[ ._-]?LA|LAT|VOSE|SUBSPA|SUBTITULADO|SUBTITULADA", "spa"),
    (r"POR|PORTUGUESE|PORTUGUES|DUBLADO|LEGENDADO|BRAZILIAN", "por"),
    (r"PT|PT[ ._-]?BR|POR[ ._-]?BR", "por"),
    (r"RUS|RUSSIAN|\x{0440}\x{0443}\x{0441}\x{0441}\x{043A}\x{0438}\x{0439}", "rus"),
    (r"RU", "rus"),
    (r"UKR|UKRAINIAN", "ukr"),
    (r"CZE|CES|CZECH|CESKY", "ces"),
    (r"CZ|CS|CZTIT", "ces"),
    (r"SLO|SK|SVK|SLOVAK|SLOVENSKY", "slk"),
    (r"POL|POLISH|POLSKI|NAPISY", "pol"),
    (r"PL", "pol"),
    (r"HUN|HUNGARIAN|MAGYAR", "hun"),
    (r"ROM|RUM|ROMANIAN", "ron"),
    (r"DUT|NLD|DUTCH|NEDERLANDS|FLEMISH|VLAAMS", "nld"),
    (r"NL", "nld"),
    (r"SWE|SE|SWEDISH|SVENSKA|SWESUB", "swe"),
    (r"DAN|DANISH|DANSK|DKSUB", "dan"),
    (r"NOR|NORWEGIAN|NORSK|NOB|NORDIC", "nor"),
    (r"FIN|FINNISH|SUOMI", "fin"),
    (r"TUR|TURKISH|T\x{00DC}RK\x{00C7}E", "tur"),
    (r"ARA|ARABIC", "ara"),
    (r"HEB|HEBREW", "heb"),
    (r"GRE|ELL|GREEK", "ell"),
    (r"THA|THAI", "tha"),
    (r"VIE|VIETNAMESE|TIENG[ ._-]?VIET", "vie"),
    (r"IND|INDONESIAN", "ind"),
    (r"MAY|MSA|MALAY", "msa"),
    (r"KOR|KOREAN|KR", "kor"),
    (r"HIN|HINDI", "hin"),
    (r"TAM|TAMIL", "tam"),
    (r"TEL|TELUGU", "tel"),
    (r"MAL|MALAYALAM", "mal"),
    (r"KAN|KANNADA", "kan"),
    (r"BEN|BENGALI", "ben"),
    (r"MAR|MARATHI", "mar"),
    (r"PAN|PUNJABI", "pan"),
    (r"CAT|CA|CATALAN|CATALA|CATALÁN", "cat"),
    (r"KIR|KIRGHIZ", "kir"),
    (r"CHI|ZHO|CHINESE|MANDARIN|CANTONESE", "zho"),
    (r"CHS|CHT|BIG5|GB|CH|SC|TC|JPSC|JPTC|中文|繁中|简中|简繁外挂|繁體|简体|中文字幕|中英字幕|中英双字|简繁英字幕|国语配音|中字|简繁字幕|中国翻訳|简繁日双语外挂|简繁内封|国语中字|繁字幕|简字幕", "zho"),
    (r"TAGALOG|TGL|FILIPINO|FIL", "tgl"),
    (r"BOSNIAN|BOS", "bos"),
    (r"BULGARIAN|BUL|BG|BGAUDIO", "bul"),
    (r"\x{56FD}\x{8BED}|\x{56FD}\x{8BED}\x{97F3}\x{8F68}|\x{666E}\x{901A}\x{8BDD}", "zho"),
    (r"ISL|ICE|ICELANDIC|ISLENSKA", "isl"),
    (r"LAV|LV|LATVIAN|LATVIESU", "lav"),
    (r"LIT|LT|LITHUANIAN|LIETUVIU", "lit"),
    (r"EST|ET|EE|ESTONIAN|EESTI", "est"),
    (r"ALB|SQI|ALBANIAN|SHQIP", "sqi"),
    (r"PER|FAS|PERSIAN|FARSI", "fas"),
    (r"GEO|KAT|GEORGIAN", "kat"),
    (r"SRP|SERBIAN|SRPSKI", "srp"),
    (r"HRV|CROATIAN|HRVATSKI", "hrv"),
    (r"SLV|SLOVENIAN|SLOVENSCINA", "slv"),
    (r"MKD|MACEDONIAN", "mkd"),
    (r"URD|URDU", "urd"),
    (r"NEP|NEPALI", "nep"),
    (r"SIN|SINHALA", "sin"),
    (r"BUR|MYA|BURMESE", "mya"),
    (r"KHM|KHMER", "khm"),
    (r"LAO|LAOTIAN", "lao"),
    (r"AZE|AZERBAIJANI", "aze"),
    (r"ARM|HYE|ARMENIAN", "hye"),
    (r"KAZ|KAZAKH", "kaz"),
    (r"UZB|UZBEK", "uzb"),
    (r"BEL|BELARUSIAN", "bel"),
    (r"FUNIDUB|FUNI[ ._-]?DUB|CR[ ._-]?DUB|ENGDUB|ENG[ ._-]?DUB", "eng"),
    (r"中英字幕|中英双字|简繁英字幕", "eng"),
    (r"粤|粤语|粵語|粤语音轨|粤语配音|粵語音軌|CANTONESE|YUE|(?:国|國)?(?:粤|粵)(?:日|英|韩)*多?(?:音轨|音軌|语配音|語配音|双语|語音軌)", "yue"),
    (r"国语|國語|官话|官話|台配|国语音轨|国语配音|CMN|MANDARIN|(?:国|國)(?:粤|粵|日|英|韩)*多?(?:音轨|音軌|语配音|語配音)", "cmn"),
    (r"(?:内封|內封|外挂|外掛|官方|特效|内嵌|DIY)?(?:简|簡|繁)(?:体|體|中|繁|日|英|法)?(?:内封|內封|外挂|外掛|内嵌)?(?:双语|雙語|双字|多语)?(?:字幕|中字|内封|外挂|内嵌|外掛)?|(?:中英|中日|英日|简日|简英|繁英|繁日|简法)(?:双语|雙語|双字)?(?:字幕|中字|内封|外挂|内嵌|特效)?|中字简体|简体字幕|简中内嵌|内封简繁中字|中文外挂字幕", "zho"),
    (r"日本語|日语|日文|日本語字幕|日语音轨|日文内封|JAPONES|JAPON\x{00C9}S|JAPONAIS", "jpn"),
    (r"韓国語|韓国翻訳|韩语|한글자막|우리말[ ._-]?더빙|한국어|COREANO|CORE(?:EN|AN)", "kor"),
    (r"INGLES|INGL\x{00C9}S|ENGLISCH|ANGLAIS|ENGL|英語|英语|英語吹替|英语配音|英語字幕", "eng"),
    (r"FRANCES|FRANC\x{00C9}S|フランス語|フランス語字幕|仏語字幕|仏字幕|法语|法语字幕|法语音轨|VOF|VF2", "fra"),
    (r"SPANI|ESPAGNOL|スペイン語|スペイン語字幕|西班牙语字幕|CAST|CASTELLANO", "spa"),
    (r"ITALIANO|イタリア語|意语|意英双语", "ita"),
    (r"LEGENDADO", "por"),
    (r"SI|SLOVENSKI", "slv"),
    (r"GR|GR[ ._-]?SUBS|GREEKSUBS", "ell"),
    (r"HR|HRVATSKI|CROSUBS", "hrv"),
    (r"DK|DKSUBS|DANSK", "dan"),
    (r"SVENSK|SVENSKA|SV[ ._-]?TEXT|SVENSK[ ._-]?TEXT", "swe"),
    (r"ROSUB|ROSUBS|ROMANA", "ron"),
    (r"SRBSUBS|SRPSKI", "srp"),
    (r"VIETSUB|TIENGVIET", "vie"),
    (r"BAHASA[ ._-]?INDONESIA|INDOSUB", "ind"),
    (r"босански|BOSANSKI", "bos"),
    (r"български|BALGARSKI", "bul"),
    (r"ру́сский|русский|рус|русская[ ._-]?озвучка", "rus"),
    (r"татар|TATAR", "tat"),
    (r"AZERBAIJAN|AZERI|AZERBAIJAN[ ._-]?DUBBED", "aze"),
    (r"TELEGU", "tel"),
    (r"UA", "ukr"),
    (r"KO", "kor"),
    (r"CHN|CHIN|CHINO|中国語字幕", "zho"),
    (r"SWISSGERMAN|SWISS[ ._-]?GERMAN|SCHWEIZERDEUTSCH", "deu"),
    (r"官方中字|中字|中文字幕", "zho"),
    (r"国英双语|国英", "cmn"),
    (r"国英双语|英语音轨", "eng"),
    (r"简繁日双语|简繁日", "zho"),
    (r"简繁日双语|日语音轨", "jpn"),
    (r"简／繁|繁／简", "zho"),
    (r"国粤语音轨|国粤", "cmn"),
    (r"国粤语音轨|粤语配音", "yue"),
    (r"简繁字幕外挂|简繁外挂字幕", "zho"),
    (r"简繁英双语字幕|简繁英双语特效字幕|中英双字幕", "zho"),
    (r"简繁日字幕|简繁日外挂", "zho"),
    (r"简繁英双语字幕|简繁英双语特效字幕|中英双字幕|英文字幕", "eng"),
    (r"简繁日字幕|简繁日外挂|日文内嵌", "jpn"),
    (r"(?:中日|日英|英日|简日|繁日)(?:双语|雙語|双字)?(?:字幕|中字|内封|外挂|内嵌|特效)?", "jpn"),
    (r"(?:中英|简英|繁英|英日|日英|意英)(?:双语|雙語|双字)?(?:字幕|中字|内封|外挂|内嵌|特效)?", "eng"),
    (r"(?:简法|中法)(?:双语|雙語|双字)?(?:字幕|中字|内封|外挂|内嵌|特效)?", "fra"),
    (r"(?:国粤)(?:双语|雙語|双字)?(?:字幕|中字|内封|外挂|内嵌|特效)?", "cmn"),
    (r"(?:国粤)(?:双语|雙語|双字)?(?:音轨|配音)?", "yue"),
    (r"台粤|台粤配|粤配", "yue"),
    (r"中文配音|华语配音|華語配音", "zho"),
    (r"(?:国|國)(?:粤|粵|日|韩)*英(?:粤|粵|日|韩)*多?(?:音轨|音軌|语配音|語配音)", "eng"),
    (r"(?:国|國)(?:粤|粵|英|韩)*日(?:粤|粵|英|韩)*多?(?:音轨|音軌|语配音|語配音)", "jpn"),
    (r"(?:国|國)(?:粤|粵|日|英)*韩(?:粤|粵|日|英)*多?(?:音轨|音軌|语配音|語配音)", "kor"),
    (r"(?:国|國)(?:粤|粵)(?:日|英|韩)*多?(?:音轨|音軌|语配音|語配音)", "yue"),
]

#: Streaming services by upper-case key without "-.+_ ".
PLATFORMS = {
    "AMZ": "AMZN",
    "AMAZON": "AMZN",
    "NETFLIX": "NF",
    "NFLX": "NF",
    "CRUNCHYROLL": "CR",
    "CRUNCHY": "CR",
    "DSNY": "DSNP",
    "DISNEY": "DSNP",
    "DISNEYPLUS": "DSNP",
    "ATV": "ATVP",
    "APPLETV": "ATVP",
    "APPLETVPLUS": "ATVP",
    "HBOMAX": "HMAX",
    "BGLOBAL": "B-GLOBAL",
    "BSTATION": "B-GLOBAL",
    "BILIBILIGLOBAL": "B-GLOBAL",
    "BILIBILI": "BILI",
    "BAHAMUT": "BAHA",
    "FUNIMATION": "FUNI",
    "FUNIDL": "FUNI",
    "HIDI": "HIDIVE",
    "PEACOCK": "PCOK",
    "PARAMOUNTPLUS": "PMTP",
    "PMNT": "PMTP",
    "BBCIPLAYER": "iP",
    "IPLAYER": "iP",
    "CH4": "ALL4",
    "CHANNEL4": "ALL4",
    "4OD": "ALL4",
    "ITV": "ITVX",
    "CHANNEL5": "MY5",
    "NOWTV": "NOW",
    "CRAVE": "CRAV",
    "MOVIESANYWHERE": "MA",
    "UNEXT": "U-NEXT",
    "YOUTUBE": "YT",
    "YTB": "YT",
    "SKYSHOWTIME": "SKST",
    "IT": "iTunes",
    "ITUNES": "iTunes",
}

#: File extensions by medium; those of "other" name no medium.
CONTAINERS = {
    "video": "mkv mp4 m4v avi ts m2ts mts wmv mov mpg mpeg flv rm rmvb vob webm ogm divx 3gp asf mk3d bdmv m2t ogv f4v".split(),
    "music": "flac mp3 m4a aac ogg opus wav wv ape alac aiff aif dsf dff mka mp2 wma mpc tta cue".split(),
    "audiobook": "m4b aax aa".split(),
    "book": "epub mobi azw azw3 pdf djvu fb2 lit prc chm avif".split(),
    "comic": "cbz cbr cb7 cbt".split(),
    "software": "exe msi iso dmg pkg apk appimage deb rpm img mds mdf nrg firm rbi sh bat xci nsp wbfs".split(),
    "subtitle": "srt ass ssa sub idx sup vtt smi".split(),
    "image": "jpg jpeg png gif bmp webp svg tif tiff".split(),
    "archive": "zip rar 7z tar gz bz2 xz zst arj ace".split(),
    "other": "nfo torrent sfv".split(),
}

#: Lower-case words that are never a release group.
REJECTED_GROUPS = """
hevc avc av1 x264 x265 h264 h265 xvid divx aac ac3 eac3 dts truehd atmos flac opus mp3 bluray bdrip brrip
webrip hdtv remux dvdrip hdrip web dl sdr hdr hdr10 hlg dovi dv uhd hd sd 10bit 8bit 12bit esub esubs sub subs
subbed dubbed dub dual audio multi org vo mvo avo vff vfi complete proper repack internal extended uncut
remastered limited unrated directors cut final edition version retail custom ntsc pal season series episode
pack batch part vol disc cd dvd dvd5 dvd9 iso aka the ita eng ger fre fra spa rus jpn kor hindi english german
french spanish russian japanese italian danish ukr ces czech s01 s02 s03 s04 s05 s06 s07 s08 s09 s10 s11 s12
mkv mp4 avi ts m2ts wmv mov srt nfo
""".split()

#: Types of spans by id, from 1.
SPAN_TYPES = """MAIN ALT subtitle_part franchise_prefix episode_title pack_marker special_marker year edition resolution
frame_size source_type platform codec bit_depth hdr audio_codec audio_feature audio_channels audio_language
subtitle_language dual_audio_tag hardsub_tag release_group site_banner tracker_tag season_marker episode_marker
volume_marker container file_extension size_tag crc32 other O season_episode_marker""".split()

#: Fields of evidence by id, from 0.
FIELDS = """title subtitle alternate_title episode_title year air_date season episode absolute_episode pack_marker
special_marker quality release_source platform edition codec hdr bit_depth remux proper repack ai_upscale hybrid
light_encode three_d downscaled audio audio_language subtitle_language dual_audio multi_audio multi_subs hard_subs
subtitle_format english_dub release_group site_banner tracker_tag container medium crc32 content_kind adult_kind
numbering_kind pack_scope special_kind franchise_prefix""".split()

#: Resolution tiers in lines, by id from 1.
TIERS = [480, 720, 1080, 1440, 2160, 4320]

#: Formats of HDR from weakest to strongest.
HDR_ORDER = ["SDR", "HDR10", "HLG", "HDR10+", "DV"]

#: Flags of a result, by bit.
FLAGS = """valid pack specials complete_range remux proper repack ten_bit dual_audio multi_audio multi_subs hard_subs
english_dub light_encode ai_upscale degraded anime""".split()

#: Numbers of a result, by bit of the mask of stated ones.
STATED = "year season season_end episode episode_end absolute_episode absolute_episode_end episode_count".split()

#: Ranges of code points by script, as names are routed.
SCRIPTS = {
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)], "hiragana": [(0x3040, 0x309F)], "katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "cyrillic": [(0x0400, 0x052F)],
    "modified_latin": [(0x00C0, 0x00D6), (0x00D8, 0x00F6), (0x00F8, 0x024F), (0x1D00, 0x1D7F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
}

#: Ranges of scripts other than Latin.
FOREIGN = [
    (0x0370, 0x03FF), (0x0400, 0x04FF), (0x0500, 0x052F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0750, 0x077F),
    (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x1100, 0x11FF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF),
    (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF),
    (0xF900, 0xFAFF), (0xFF01, 0xFF60), (0xFF61, 0xFF9F), (0x20000, 0x2A6DF),
]
