"""Hand-checked texts and their kinds: HOLDOUT calibrates the page classifier and is never fitted, EXAMPLES stand in for classes that a sample lacks."""

HOLDOUT = [
    ("The river ran past the mill, and the children who played there knew every stone.\nIn the evening they went home.", "prose"),
    ("While the old man from the village waited at the gate, a letter came for him. He read it twice.", "prose"),
    ("আমাদের গ্রামের পাশে একটি নদী আছে। সেই নদী থেকে সবাই জল আনে এবং মাছ ধরে।", "prose"),
    ("যদি কাল বৃষ্টি হয় তবে আমরা ঘরে থাকব না, কারণ মেলা এখন শুরু হবে।", "prose"),
    ("यह पुस्तक बहुत पुरानी है और इसके बारे में कोई नहीं जानता। लेकिन सभी लोग इसको पढ़ना चाहते हैं।", "prose"),
    ("हा रस्ता नदी जवळ आहे आणि तो गाव मध्ये जातो. मग आपला प्रवास पुन्हा सुरू होतो.", "prose"),
    ("এই নদীৰ ওচৰত আমাৰ ঘৰ আছে আৰু সেই ঘৰত বহুত মানুহ থাকে।", "prose"),
    ("amader gramer pashe ekti nodi achhe. sei nodi theke sobai jol ane ebong machh dhore bikele.", "prose"),
    ("O gentle wind that over water goes,\nand bring the song that from the garden rose,\nuntil the night between the hills and sea\nshall close.", "prose"),
    ("1. The first rule is that each of the members must pay before the end of the year.\n\n2. The second is that no one may leave while the vote is open.", "prose"),
    ("apples\nred pears\nbread\nsalt\nolive oil\ncandles\nrice\nlamp", "list"),
    ("• কলম\n• খাতা বই\n• দোয়াত\n• কাগজ\n• চক\n• ছাতা", "list"),
    ("1. चावल\n2. दाल\n3. नमक तेल\n4. आटा\n5. चीनी\n6. दूध", "list"),
    ("Preface .......... 3\nThe mill ............ 12\nThe river .... 47\nHomecoming ............ 90", "list"),
    ("ভূমিকা ......... ৫\nনদী ............... ১৭\nঘর ফেরা ........ ৬৪\nশেষ ..... ৯০", "list"),
    ("barley, 12, 48\nclover, 7\nmeadow, 33, 91\nplough, 5, 60\nwheat, 17, 71", "list"),
    ("ox: farm animal\nplough: tool\nseed barn: building\nwell: water", "list"),
    ("| crop | 1990 | 1991 |\n|---|---|---|\n| rice | 8812 | 9120 |\n| jute | 341 | 388.5 |\n| wheat | - | 77 |", "table"),
    ("নাম\tবয়স\tনম্বর\nরাম\t১২\t৮৮\nশ্যাম\t১৩\t৭১\nযদু\t১১\t৯৩", "table"),
    ("item      price     stock\nlamp      12.50     118\nrope      3.20      94\nbell      -         17", "table"),
    ("गाँव;घर;लोग;खेत\nरामपुर;120;640;88\nसोनपुर;77;391;52\nमधुपुर;203;998;140", "table"),
    ("{}#[ @@^ %$ ~~ |/ <> ^^\n*&^ %$# {{ ]] ~/ <\n@@ #^ &* }{ [~", "junk"),
    ("Qx7/9aK2LmVv0PzR4tYw8sDfGhJk3BnM\nZ1xC5vB7nM9aS2dF4gH6jK8lQ0wE3rT5\nyU7iO9pA1sD3fG5hJ7kL9zX2cV4bN6mQ", "junk"),
    ("hgrt klpw zxcv bnmq\nwrtp sdfg hjkl zxcv\nmnbv lkjh gfds qwrt pqrt", "junk"),
    ("কতপ মনজ গঘচ টঠডঢ পফবভ\nশষসহ কখগঘ চছজঝ টঠডঢণ তথদধ\nপফব মযর লশষ হকখ", "junk"),
    ("ািক ুতম েোপ ্নর ীগম ৈকপ\nাতি িমু ূরপ েকগ োনম ্পত\nীলব ুকট ৃমর", "junk"),
    ("50938.2:7X1 ~-_'.\n88213%(4 .'`-~\n70215X6 ~~--'_\n9931:20 `'-.~", "junk"),
]

EXAMPLES = [
    ("She put the lamp on the table and waited for her brother, who had gone to the well before dark.\nAt last they heard his step at the gate.", "prose"),
    ("It was late when the boat came in. The men were tired and the sail was torn, but the nets were full of fish from the bay.", "prose"),
    ("পাহাড়ের কাছে একটি পুরনো বাড়ি ছিল এবং সেই বাড়ির সামনে একটি বাগান ছিল। তার মালিক কিন্তু দূরের শহরে থাকে।", "prose"),
    ("पहाड़ के पास एक पुराना घर था और उस घर के सामने बाग था। वहाँ से शहर बहुत दूर है लेकिन लोग पैदल जाते हैं।", "prose"),
    ("डोंगर जवळ एक जुने घर आहे आणि त्या घर वर लाल कौले आहेत. मुले तेथे खेळतात.", "prose"),
    ("পাহাৰৰ ওচৰত এটা পুৰণি ঘৰ আছিল আৰু সেই ঘৰৰ আগত এখন বাগিচা আছিল। মানুহজন কিন্তু চহৰত থাকে।", "prose"),
    ("milk\nblack tea\nsoap\nmatches\nneedles\ncotton thread\nsugar", "list"),
    ("- আলু\n- পটল\n- লাল শাক\n- মাছ\n- তেল", "list"),
    ("1. चादर\n2. तकिया\n3. लोटा\n4. थाली कटोरी\n5. दरी", "list"),
    ("Chapter one ......... 1\nThe fair ........... 19\nThe flood ....... 38\nNotes ......... 102", "list"),
    ("anchor, 9\nharbour, 14, 55\nmast, 21\nsail, 3, 30\ntide, 61", "list"),
    ("bell: of brass\nrope: of jute\noar: of teak\nsail cloth: of cotton", "list"),
    ("| port | ships | tons |\n|---|---|---|\n| east | 41 | 7730 |\n| west | 18 | 2095.5 |\n| south | - | 310 |", "table"),
    ("মাস\tবৃষ্টি\tদিন\nআষাঢ়\t৩১২\t১৯\nশ্রাবণ\t৪০৫\t২২\nভাদ্র\t২৮৮\t১৭", "table"),
    ("month     rain      days\nJune      312.4     19\nJuly      405.0     22\nAugust    -         17", "table"),
    ("मद;दाम;नग;कुल\nकलम;12;30;360\nकागज;3;200;600\nदवात;25;8;200", "table"),
    ("port;ships;tons\neast;41;7730\nwest;18;2095\nsouth;7;310", "table"),
    ("%%$ #@! ^^& *(( ))_ +=\n~~` {}{} ||// <<>>\n##@ !!% ^&* ((", "junk"),
    ("Bq8/zR3mWp5NxT7vLs2KdHy6Gj9FcQ1u\nXe4oMa8rVi2wZk7nBt5hPq3sYl9gDf6j", "junk"),
    ("dfgh trwq plkj mnvx\nqzxw crtv bnhg tjmk\nplmn krwt zxcv dfgh", "junk"),
    ("খগঘ চছজ টঠড তথদ পফব\nমযর লশষ সহক গঘচ জটঠ\nডতথ দপফ বময রলশ", "junk"),
    ("াকত েবপ ্মর িলন ুগজ োদট\nীসহ ৈকব াপত েরম িনল", "junk"),
    ("7719-.3:0 2~ '_.`\n1182)(6 .'~- 04\n`~-_ 9935:1 .'-", "junk"),
]
