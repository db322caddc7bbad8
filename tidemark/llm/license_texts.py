"""Standard licence bodies and file headers as lower-case words, by label: templates of the license scan.

The bodies of GPL 3 and LGPL 2.1 are there with their preambles, as the terms of GPL 3 are also
those of AGPL 3. Headers begin after the name of what they license.
"""

BODIES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether "
        "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any "
        "express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
        "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
        "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
        "this software even if advised of the possibility of such damage",
    ),
    (
        "bsd-3-clause",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "bsd-4-clause",
        "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "0bsd",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and "
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
        "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you "
        "wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not "
        "be removed or altered from any source distribution",
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to "
        "permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire "
        "statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or "
        "in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code "
        "generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone "
        "distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
        "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ),
    (
        "gpl-2.0",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version",
    ),
    (
        "gpl-2.0",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free "
        "software foundation",
    ),
    (
        "gpl-3.0",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ),
    (
        "gpl-3.0",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free "
        "software foundation",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the "
        "free software foundation",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3 as published by the free "
        "software foundation",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu library general public license version 2 as published by the free "
        "software foundation",
    ),
    (
        "agpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ),
    (
        "agpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license version 3 as published by the free "
        "software foundation",
    ),
    (
        "agpl",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation "
        "with the community in the case of network server software",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
        "obtain one at http mozilla org mpl 2 0",
    ),
    (
        "apache-2.0",
        "terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and "
        "distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner "
        "that is granting the license legal entity shall mean the union of the acting entity and all other entities that control are controlled by or are under "
        "common control with that entity for the purposes of this definition control means i the power direct or indirect to cause the direction or management "
        "of such entity whether by contract or otherwise or ii ownership of fifty percent 50 or more of the outstanding shares or iii beneficial ownership of "
        "such entity you or your shall mean an individual or legal entity exercising permissions granted by this license source form shall mean the preferred "
        "form for making modifications including but not limited to software source code documentation source and configuration files object form shall mean "
        "any form resulting from mechanical transformation or translation of a source form including but not limited to compiled object code generated "
        "documentation and conversions to other media types work shall mean the work of authorship whether in source or object form made available under the "
        "license as indicated by a copyright notice that is included in or attached to the work an example is provided in the appendix below derivative works "
        "shall mean any work whether in source or object form that is based on or derived from the work and for which the editorial revisions annotations "
        "elaborations or other modifications represent as a whole an original work of authorship for the purposes of this license derivative works shall not "
        "include works that remain separable from or merely link or bind by name to the interfaces of the work and derivative works thereof contribution shall "
        "mean any work of authorship including the original version of the work and any modifications or additions to that work or derivative works thereof "
        "that is intentionally submitted to licensor for inclusion in the work by the copyright owner or by an individual or legal entity authorized to submit "
        "on behalf of the copyright owner for the purposes of this definition submitted means any form of electronic verbal or written communication sent to "
        "the licensor or its representatives including but not limited to communication on electronic mailing lists source code control systems and issue "
        "tracking systems that are managed by or on behalf of the licensor for the purpose of discussing and improving the work but excluding communication "
        "that is conspicuously marked or otherwise designated in writing by the copyright owner as not a contribution contributor shall mean licensor and any "
        "individual or legal entity on behalf of whom a contribution has been received by licensor and subsequently incorporated within the work 2 grant of "
        "copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no "
        "charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute "
        "the work and such derivative works in source or object form 3 grant of patent license subject to the terms and conditions of this license each "
        "contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent "
        "license to make have made use offer to sell sell import and otherwise transfer the work where such license applies only to those patent claims "
        "licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their contribution s with the work to "
        "which such contribution s was submitted if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit "
        "alleging that the work or a contribution incorporated within the work constitutes direct or contributory patent infringement then any patent licenses "
        "granted to you under this license for that work shall terminate as of the date such litigation is filed 4 redistribution you may reproduce and "
        "distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you "
        "meet the following conditions a you must give any other recipients of the work or derivative works a copy of this license and b you must cause any "
        "modified files to carry prominent notices stating that you changed the files and c you must retain in the source form of any derivative works that you "
        "distribute all copyright patent trademark and attribution notices from the source form of the work excluding those notices that do not pertain to any "
        "part of the derivative works and d if the work includes a notice text file as part of its distribution then any derivative works that you distribute "
        "must include a readable copy of the attribution notices contained within such notice file excluding those notices that do not pertain to any part of "
        "the derivative works in at least one of the following places within a notice text file distributed as part of the derivative works within the source "
        "form or documentation if provided along with the derivative works or within a display generated by the derivative works if and wherever such third "
        "party notices normally appear the contents of the notice file are for informational purposes only and do not modify the license you may add your own "
        "attribution notices within derivative works that you distribute alongside or as an addendum to the notice text from the work provided that such "
        "additional attribution notices cannot be construed as modifying the license you may add your own copyright statement to your modifications and may "
        "provide additional or different license terms and conditions for use reproduction or distribution of your modifications or for any such derivative "
        "works as a whole provided your use reproduction and distribution of the work otherwise complies with the conditions stated in this license 5 "
        "submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by you to the "
        "licensor shall be under the terms and conditions of this license without any additional terms or conditions notwithstanding the above nothing herein "
        "shall supersede or modify the terms of any separate license agreement you may have executed with licensor regarding such contributions 6 trademarks "
        "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for "
        "reasonable and customary use in describing the origin of the work and reproducing the content of the notice file 7 disclaimer of warranty unless "
        "required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis "
        "without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non "
        "infringement merchantability or fitness for a particular purpose you are solely responsible for determining the appropriateness of using or "
        "redistributing the work and assume any risks associated with your exercise of permissions under this license 8 limitation of liability in no event and "
        "under no legal theory whether in tort including negligence contract or otherwise unless required by applicable law such as deliberate and grossly "
        "negligent acts or agreed to in writing shall any contributor be liable to you for damages including any direct indirect special incidental or "
        "consequential damages of any character arising as a result of this license or out of the use or inability to use the work including but not limited to "
        "damages for loss of goodwill work stoppage computer failure or malfunction or any and all other commercial damages or losses even if such contributor "
        "has been advised of the possibility of such damages 9 accepting warranty or additional liability while redistributing the work or derivative works "
        "thereof you may choose to offer and charge a fee for acceptance of support warranty indemnity or other liability obligations and or rights consistent "
        "with this license however in accepting such obligations you may act only on your own behalf and on your sole responsibility not on behalf of any other "
        "contributor and only if you agree to indemnify defend and hold each contributor harmless for any liability incurred by or claims asserted against such "
        "contributor by reason of your accepting any such warranty or additional liability",
    ),
    (
        "mpl-2.0",
        "1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software 1 2 "
        "contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s contribution 1 "
        "3 contribution means covered software of a particular contributor 1 4 covered software means source code form to which the initial contributor has "
        "attached the notice in exhibit a the executable form of such source code form and modifications of such source code form in each case including "
        "portions thereof 1 5 incompatible with secondary licenses means a that the initial contributor has attached the notice described in exhibit b to the "
        "covered software or b that the covered software was made available under the terms of version 1 1 or earlier of the license but not also under the "
        "terms of a secondary license 1 6 executable form means any form of the work other than source code form 1 7 larger work means a work that combines "
        "covered software with other material in a separate file or files that is not covered software 1 8 license means this document 1 9 licensable means "
        "having the right to grant to the maximum extent possible whether at the time of the initial grant or subsequently any and all of the rights conveyed "
        "by this license 1 10 modifications means any of the following a any file in source code form that results from an addition to deletion from or "
        "modification of the contents of covered software or b any new file in source code form that contains any covered software 1 11 patent claims of a "
        "contributor means any patent claim s including without limitation method process and apparatus claims in any patent licensable by such contributor "
        "that would be infringed but for the grant of the license by the making using selling offering for sale having made import or transfer of either its "
        "contributions or its contributor version 1 12 secondary license means either the gnu general public license version 2 0 the gnu lesser general public "
        "license version 2 1 the gnu affero general public license version 3 0 or any later versions of those licenses 1 13 source code form means the form of "
        "the work preferred for making modifications 1 14 you or your means an individual or a legal entity exercising rights under this license for legal "
        "entities you includes any entity that controls is controlled by or is under common control with you for purposes of this definition control means a "
        "the power direct or indirect to cause the direction or management of such entity whether by contract or otherwise or b ownership of more than fifty "
        "percent 50 of the outstanding shares or beneficial ownership of such entity 2 license grants and conditions 2 1 grants each contributor hereby grants "
        "you a world wide royalty free non exclusive license a under intellectual property rights other than patent or trademark licensable by such contributor "
        "to use reproduce make available modify display perform distribute and otherwise exploit its contributions either on an unmodified basis with "
        "modifications or as part of a larger work and b under patent claims of such contributor to make use sell offer for sale have made import and otherwise "
        "transfer either its contributions or its contributor version 2 2 effective date the licenses granted in section 2 1 with respect to any contribution "
        "become effective for each contribution on the date the contributor first distributes such contribution 2 3 limitations on grant scope the licenses "
        "granted in this section 2 are the only rights granted under this license no additional rights or licenses will be implied from the distribution or "
        "licensing of covered software under this license notwithstanding section 2 1 b above no patent license is granted by a contributor a for any code that "
        "a contributor has removed from covered software or b for infringements caused by i your and any other third party s modifications of covered software "
        "or ii the combination of its contributions with other software except as part of its contributor version or c under patent claims infringed by covered "
        "software in the absence of its contributions this license does not grant any rights in the trademarks service marks or logos of any contributor except "
        "as may be necessary to comply with the notice requirements in section 3 4 2 4 subsequent licenses no contributor makes additional grants as a result "
        "of your choice to distribute the covered software under a subsequent version of this license see section 10 2 or under the terms of a secondary "
        "license if permitted under the terms of section 3 3 2 5 representation each contributor represents that the contributor believes its contributions are "
        "its original creation s or it has sufficient rights to grant the rights to its contributions conveyed by this license 2 6 fair use this license is not "
        "intended to limit any rights you have under applicable copyright doctrines of fair use fair dealing or other equivalents 2 7 conditions sections 3 1 3 "
        "2 3 3 and 3 4 are conditions of the licenses granted in section 2 1 3 responsibilities 3 1 distribution of source form all distribution of covered "
        "software in source code form including any modifications that you create or to which you contribute must be under the terms of this license you must "
        "inform recipients that the source code form of the covered software is governed by the terms of this license and how they can obtain a copy of this "
        "license you may not attempt to alter or restrict the recipients rights in the source code form 3 2 distribution of executable form if you distribute "
        "covered software in executable form then a such covered software must also be made available in source code form as described in section 3 1 and you "
        "must inform recipients of the executable form how they can obtain a copy of such source code form by reasonable means in a timely manner at a charge "
        "no more than the cost of distribution to the recipient and b you may distribute such executable form under the terms of this license or sublicense it "
        "under different terms provided that the license for the executable form does not attempt to limit or alter the recipients rights in the source code "
        "form under this license 3 3 distribution of a larger work you may create and distribute a larger work under terms of your choice provided that you "
        "also comply with the requirements of this license for the covered software if the larger work is a combination of covered software with a work "
        "governed by one or more secondary licenses and the covered software is not incompatible with secondary licenses this license permits you to "
        "additionally distribute such covered software under the terms of such secondary license s so that the recipient of the larger work may at their option "
        "further distribute the covered software under the terms of either this license or such secondary license s 3 4 notices you may not remove or alter the "
        "substance of any license notices including copyright notices patent notices disclaimers of warranty or limitations of liability contained within the "
        "source code form of the covered software except that you may alter any license notices to the extent required to remedy known factual inaccuracies 3 5 "
        "application of additional terms you may choose to offer and to charge a fee for warranty support indemnity or liability obligations to one or more "
        "recipients of covered software however you may do so only on your own behalf and not on behalf of any contributor you must make it absolutely clear "
        "that any such warranty support indemnity or liability obligation is offered by you alone and you hereby agree to indemnify every contributor for any "
        "liability incurred by such contributor as a result of warranty support indemnity or liability terms you offer you may include additional disclaimers "
        "of warranty and limitations of liability specific to any jurisdiction 4 inability to comply due to statute or regulation if it is impossible for you "
        "to comply with any of the terms of this license with respect to some or all of the covered software due to statute judicial order or regulation then "
        "you must a comply with the terms of this license to the maximum extent possible and b describe the limitations and the code they affect such "
        "description must be placed in a text file included with all distributions of the covered software under this license except to the extent prohibited "
        "by statute or regulation such description must be sufficiently detailed for a recipient of ordinary skill to be able to understand it 5 termination 5 "
        "1 the rights granted under this license will terminate automatically if you fail to comply with any of its terms however if you become compliant then "
        "the rights granted under this license from a particular contributor are reinstated a provisionally unless and until such contributor explicitly and "
        "finally terminates your grants and b on an ongoing basis if such contributor fails to notify you of the non compliance by some reasonable means prior "
        "to 60 days after you have come back into compliance moreover your grants from a particular contributor are reinstated on an ongoing basis if such "
        "contributor notifies you of the non compliance by some reasonable means this is the first time you have received notice of non compliance with this "
        "license from such contributor and you become compliant prior to 30 days after your receipt of the notice 5 2 if you initiate litigation against any "
        "entity by asserting a patent infringement claim excluding declaratory judgment actions counter claims and cross claims alleging that a contributor "
        "version directly or indirectly infringes any patent then the rights granted to you by any and all contributors for the covered software under section "
        "2 1 of this license shall terminate 5 3 in the event of termination under sections 5 1 or 5 2 above all end user license agreements excluding "
        "distributors and resellers which have been validly granted by you or your distributors under this license prior to termination shall survive "
        "termination 6 disclaimer of warranty covered software is provided under this license on an as is basis without warranty of any kind either expressed "
        "implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or "
        "non infringing the entire risk as to the quality and performance of the covered software is with you should any covered software prove defective in "
        "any respect you not any contributor assume the cost of any necessary servicing repair or correction this disclaimer of warranty constitutes an "
        "essential part of this license no use of any covered software is authorized under this license except under this disclaimer 7 limitation of liability "
        "under no circumstances and under no legal theory whether tort including negligence contract or otherwise shall any contributor or anyone who "
        "distributes covered software as permitted above be liable to you for any direct indirect special incidental or consequential damages of any character "
        "including without limitation damages for lost profits loss of goodwill work stoppage computer failure or malfunction or any and all other commercial "
        "damages or losses even if such party shall have been informed of the possibility of such damages this limitation of liability shall not apply to "
        "liability for death or personal injury resulting from such party s negligence to the extent applicable law prohibits such limitation some "
        "jurisdictions do not allow the exclusion or limitation of incidental or consequential damages so this exclusion and limitation may not apply to you 8 "
        "litigation any litigation relating to this license may be brought only in the courts of a jurisdiction where the defendant maintains its principal "
        "place of business and such litigation shall be governed by laws of that jurisdiction without reference to its conflict of law provisions nothing in "
        "this section shall prevent a party s ability to bring cross claims or counter claims 9 miscellaneous this license represents the complete agreement "
        "concerning the subject matter hereof if any provision of this license is held to be unenforceable such provision shall be reformed only to the extent "
        "necessary to make it enforceable any law or regulation which provides that the language of a contract shall be construed against the drafter shall not "
        "be used to construe this license against a contributor 10 versions of the license 10 1 new versions mozilla foundation is the license steward except "
        "as provided in section 10 3 no one other than the license steward has the right to modify or publish new versions of this license each version will be "
        "given a distinguishing version number 10 2 effect of new versions you may distribute the covered software under the terms of the version of the "
        "license under which you originally received the covered software or under the terms of any subsequent version published by the license steward 10 3 "
        "modified versions if you create software not governed by this license and you want to create a new license for such software you may create and use a "
        "modified version of this license if you rename the license and remove any references to the name of the license steward except to note that such "
        "modified license differs from this license 10 4 distributing source code form that is incompatible with secondary licenses if you choose to distribute "
        "source code form that is incompatible with secondary licenses under the terms of this version of the license the notice described in exhibit b of this "
        "license must be attached",
    ),
    (
        "gpl-2.0",
        "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 "
        "usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the licenses for "
        "most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your "
        "freedom to share and change free software to make sure the software is free for all its users this general public license applies to most of the free "
        "software foundation s software and to any other program whose authors commit to using it some other free software foundation software is covered by "
        "the gnu lesser general public license instead you can apply it to your programs too when we speak of free software we are referring to freedom not "
        "price our general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge for this "
        "service if you wish that you receive source code or can get it if you want it that you can change the software or use pieces of it in new free "
        "programs and that you know you can do these things to protect your rights we need to make restrictions that forbid anyone to deny you these rights or "
        "to ask you to surrender the rights these restrictions translate to certain responsibilities for you if you distribute copies of the software or if you "
        "modify it for example if you distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights that you have "
        "you must make sure that they too receive or can get the source code and you must show them these terms so they know their rights we protect your "
        "rights with two steps 1 copyright the software and 2 offer you this license which gives you legal permission to copy distribute and or modify the "
        "software also for each author s protection and ours we want to make certain that everyone understands that there is no warranty for this free software "
        "if the software is modified by someone else and passed on we want its recipients to know that what they have is not the original so that any problems "
        "introduced by others will not reflect on the original authors reputations finally any free program is threatened constantly by software patents we "
        "wish to avoid the danger that redistributors of a free program will individually obtain patent licenses in effect making the program proprietary to "
        "prevent this we have made it clear that any patent must be licensed for everyone s free use or not licensed at all the precise terms and conditions "
        "for copying distribution and modification follow gnu general public license terms and conditions for copying distribution and modification 0 this "
        "license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of "
        "this general public license the program below refers to any such program or work and a work based on the program means either the program or any "
        "derivative work under copyright law that is to say a work containing the program or a portion of it either verbatim or with modifications and or "
        "translated into another language hereinafter translation is included without limitation in the term modification each licensee is addressed as you "
        "activities other than copying distribution and modification are not covered by this license they are outside its scope the act of running the program "
        "is not restricted and the output from the program is covered only if its contents constitute a work based on the program independent of having been "
        "made by running the program whether that is true depends on what the program does 1 you may copy and distribute verbatim copies of the program s "
        "source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and "
        "disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and give any other recipients of the "
        "program a copy of this license along with the program you may charge a fee for the physical act of transferring a copy and you may at your option "
        "offer warranty protection in exchange for a fee 2 you may modify your copy or copies of the program or any portion of it thus forming a work based on "
        "the program and copy and distribute such modifications or work under the terms of section 1 above provided that you also meet all of these conditions "
        "a you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change b you must cause any work "
        "that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof to be licensed as a whole at no "
        "charge to all third parties under the terms of this license c if the modified program normally reads commands interactively when run you must cause it "
        "when started running for such interactive use in the most ordinary way to print or display an announcement including an appropriate copyright notice "
        "and a notice that there is no warranty or else saying that you provide a warranty and that users may redistribute the program under these conditions "
        "and telling the user how to view a copy of this license exception if the program itself is interactive but does not normally print such an "
        "announcement your work based on the program is not required to print an announcement these requirements apply to the modified work as a whole if "
        "identifiable sections of that work are not derived from the program and can be reasonably considered independent and separate works in themselves then "
        "this license and its terms do not apply to those sections when you distribute them as separate works but when you distribute the same sections as part "
        "of a whole which is a work based on the program the distribution of the whole must be on the terms of this license whose permissions for other "
        "licensees extend to the entire whole and thus to each and every part regardless of who wrote it thus it is not the intent of this section to claim "
        "rights or contest your rights to work written entirely by you rather the intent is to exercise the right to control the distribution of derivative or "
        "collective works based on the program in addition mere aggregation of another work not based on the program with the program or with a work based on "
        "the program on a volume of a storage or distribution medium does not bring the other work under the scope of this license 3 you may copy and "
        "distribute the program or a work based on it under section 2 in object code or executable form under the terms of sections 1 and 2 above provided that "
        "you also do one of the following a accompany it with the complete corresponding machine readable source code which must be distributed under the terms "
        "of sections 1 and 2 above on a medium customarily used for software interchange or b accompany it with a written offer valid for at least three years "
        "to give any third party for a charge no more than your cost of physically performing source distribution a complete machine readable copy of the "
        "corresponding source code to be distributed under the terms of sections 1 and 2 above on a medium customarily used for software interchange or c "
        "accompany it with the information you received as to the offer to distribute corresponding source code this alternative is allowed only for "
        "noncommercial distribution and only if you received the program in object code or executable form with such an offer in accord with subsection b above "
        "the source code for a work means the preferred form of the work for making modifications to it for an executable work complete source code means all "
        "the source code for all modules it contains plus any associated interface definition files plus the scripts used to control compilation and "
        "installation of the executable however as a special exception the source code distributed need not include anything that is normally distributed in "
        "either source or binary form with the major components compiler kernel and so on of the operating system on which the executable runs unless that "
        "component itself accompanies the executable if distribution of executable or object code is made by offering access to copy from a designated place "
        "then offering equivalent access to copy the source code from the same place counts as distribution of the source code even though third parties are "
        "not compelled to copy the source along with the object code 4 you may not copy modify sublicense or distribute the program except as expressly "
        "provided under this license any attempt otherwise to copy modify sublicense or distribute the program is void and will automatically terminate your "
        "rights under this license however parties who have received copies or rights from you under this license will not have their licenses terminated so "
        "long as such parties remain in full compliance 5 you are not required to accept this license since you have not signed it however nothing else grants "
        "you permission to modify or distribute the program or its derivative works these actions are prohibited by law if you do not accept this license "
        "therefore by modifying or distributing the program or any work based on the program you indicate your acceptance of this license to do so and all its "
        "terms and conditions for copying distributing or modifying the program or works based on it 6 each time you redistribute the program or any work based "
        "on the program the recipient automatically receives a license from the original licensor to copy distribute or modify the program subject to these "
        "terms and conditions you may not impose any further restrictions on the recipients exercise of the rights granted herein you are not responsible for "
        "enforcing compliance by third parties to this license 7 if as a consequence of a court judgment or allegation of patent infringement or for any other "
        "reason not limited to patent issues conditions are imposed on you whether by court order agreement or otherwise that contradict the conditions of this "
        "license they do not excuse you from the conditions of this license if you cannot distribute so as to satisfy simultaneously your obligations under "
        "this license and any other pertinent obligations then as a consequence you may not distribute the program at all for example if a patent license would "
        "not permit royalty free redistribution of the program by all those who receive copies directly or indirectly through you then the only way you could "
        "satisfy both it and this license would be to refrain entirely from distribution of the program if any portion of this section is held invalid or "
        "unenforceable under any particular circumstance the balance of the section is intended to apply and the section as a whole is intended to apply in "
        "other circumstances it is not the purpose of this section to induce you to infringe any patents or other property right claims or to contest validity "
        "of any such claims this section has the sole purpose of protecting the integrity of the free software distribution system which is implemented by "
        "public license practices many people have made generous contributions to the wide range of software distributed through that system in reliance on "
        "consistent application of that system it is up to the author donor to decide if he or she is willing to distribute software through any other system "
        "and a licensee cannot impose that choice this section is intended to make thoroughly clear what is believed to be a consequence of the rest of this "
        "license 8 if the distribution and or use of the program is restricted in certain countries either by patents or by copyrighted interfaces the original "
        "copyright holder who places the program under this license may add an explicit geographical distribution limitation excluding those countries so that "
        "distribution is permitted only in or among countries not thus excluded in such case this license incorporates the limitation as if written in the body "
        "of this license 9 the free software foundation may publish revised and or new versions of the general public license from time to time such new "
        "versions will be similar in spirit to the present version but may differ in detail to address new problems or concerns each version is given a "
        "distinguishing version number if the program specifies a version number of this license which applies to it and any later version you have the option "
        "of following the terms and conditions either of that version or of any later version published by the free software foundation if the program does not "
        "specify a version number of this license you may choose any version ever published by the free software foundation 10 if you wish to incorporate parts "
        "of the program into other free programs whose distribution conditions are different write to the author to ask for permission for software which is "
        "copyrighted by the free software foundation write to the free software foundation we sometimes make exceptions for this our decision will be guided by "
        "the two goals of preserving the free status of all derivatives of our free software and of promoting the sharing and reuse of software generally no "
        "warranty 11 because the program is licensed free of charge there is no warranty for the program to the extent permitted by applicable law except when "
        "otherwise stated in writing the copyright holders and or other parties provide the program as is without warranty of any kind either expressed or "
        "implied including but not limited to the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the quality "
        "and performance of the program is with you should the program prove defective you assume the cost of all necessary servicing repair or correction 12 "
        "in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or redistribute "
        "the program as permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use "
        "or inability to use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third "
        "parties or a failure of the program to operate with any other programs even if such holder or other party has been advised of the possibility of such "
        "damages",
    ),
    (
        "lgpl",
        "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org everyone is permitted to copy and "
        "distribute verbatim copies of this license document but changing it is not allowed this version of the gnu lesser general public license incorporates "
        "the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below 0 additional "
        "definitions as used herein this license refers to version 3 of the gnu lesser general public license and the gnu gpl refers to version 3 of the gnu "
        "general public license the library refers to a covered work governed by this license other than an application or a combined work as defined below an "
        "application is any work that makes use of an interface provided by the library but which is not otherwise based on the library defining a subclass of "
        "a class defined by the library is deemed a mode of using an interface provided by the library a combined work is a work produced by combining or "
        "linking an application with the library the particular version of the library with which the combined work was made is also called the linked version "
        "the minimal corresponding source for a combined work means the corresponding source for the combined work excluding any source code for portions of "
        "the combined work that considered in isolation are based on the application and not on the linked version the corresponding application code for a "
        "combined work means the object code and or source code for the application including any data and utility programs needed for reproducing the combined "
        "work from the application but excluding the system libraries of the combined work 1 exception to section 3 of the gnu gpl you may convey a covered "
        "work under sections 3 and 4 of this license without being bound by section 3 of the gnu gpl 2 conveying modified versions if you modify a copy of the "
        "library and in your modifications a facility refers to a function or data to be supplied by an application that uses the facility other than as an "
        "argument passed when the facility is invoked then you may convey a copy of the modified version a under this license provided that you make a good "
        "faith effort to ensure that in the event an application does not supply the function or data the facility still operates and performs whatever part of "
        "its purpose remains meaningful or b under the gnu gpl with none of the additional permissions of this license applicable to that copy 3 object code "
        "incorporating material from library header files the object code form of an application may incorporate material from a header file that is part of "
        "the library you may convey such object code under terms of your choice provided that if the incorporated material is not limited to numerical "
        "parameters data structure layouts and accessors or small macros inline functions and templates ten or fewer lines in length you do both of the "
        "following a give prominent notice with each copy of the object code that the library is used in it and that the library and its use are covered by "
        "this license b accompany the object code with a copy of the gnu gpl and this license document 4 combined works you may convey a combined work under "
        "terms of your choice that taken together effectively do not restrict modification of the portions of the library contained in the combined work and "
        "reverse engineering for debugging such modifications if you also do each of the following a give prominent notice with each copy of the combined work "
        "that the library is used in it and that the library and its use are covered by this license b accompany the combined work with a copy of the gnu gpl "
        "and this license document c for a combined work that displays copyright notices during execution include the copyright notice for the library among "
        "these notices as well as a reference directing the user to the copies of the gnu gpl and this license document d do one of the following 0 convey the "
        "minimal corresponding source under the terms of this license and the corresponding application code in a form suitable for and under terms that permit "
        "the user to recombine or relink the application with a modified version of the linked version to produce a modified combined work in the manner "
        "specified by section 6 of the gnu gpl for conveying corresponding source 1 use a suitable shared library mechanism for linking with the library a "
        "suitable mechanism is one that a uses at run time a copy of the library already present on the user s computer system and b will operate properly with "
        "a modified version of the library that is interface compatible with the linked version e provide installation information but only if you would "
        "otherwise be required to provide such information under section 6 of the gnu gpl and only to the extent that such information is necessary to install "
        "and execute a modified version of the combined work produced by recombining or relinking the application with a modified version of the linked version "
        "if you use option 4d0 the installation information must accompany the minimal corresponding source and corresponding application code if you use "
        "option 4d1 you must provide the installation information in the manner specified by section 6 of the gnu gpl for conveying corresponding source 5 "
        "combined libraries you may place library facilities that are a work based on the library side by side in a single library together with other library "
        "facilities that are not applications and are not covered by this license and convey such a combined library under terms of your choice if you do both "
        "of the following a accompany the combined library with a copy of the same work based on the library uncombined with any other library facilities "
        "conveyed under the terms of this license b give prominent notice with the combined library that part of it is a work based on the library and "
        "explaining where to find the accompanying uncombined form of the same work 6 revised versions of the gnu lesser general public license the free "
        "software foundation may publish revised and or new versions of the gnu lesser general public license from time to time such new versions will be "
        "similar in spirit to the present version but may differ in detail to address new problems or concerns each version is given a distinguishing version "
        "number if the library as you received it specifies that a certain numbered version of the gnu lesser general public license or any later version "
        "applies to it you have the option of following the terms and conditions either of that published version or of any later version published by the free "
        "software foundation if the library as you received it does not specify a version number of the gnu lesser general public license you may choose any "
        "version of the gnu lesser general public license ever published by the free software foundation if the library as you received it specifies that a "
        "proxy can decide whether future versions of the gnu lesser general public license shall apply that proxy s public statement of acceptance of any "
        "version is permanent authorization for you to choose that version for the library",
    ),
    (
        "gpl-3.0",
        "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical "
        "works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your "
        "freedom to share and change all versions of a program to make sure it remains free software for all its users we the free software foundation use the "
        "gnu general public license for most of our software it applies also to any other work released this way by its authors you can apply it to your "
        "programs too when we speak of free software we are referring to freedom not price our general public licenses are designed to make sure that you have "
        "the freedom to distribute copies of free software and charge for them if you wish that you receive source code or can get it if you want it that you "
        "can change the software or use pieces of it in new free programs and that you know you can do these things to protect your rights we need to prevent "
        "others from denying you these rights or asking you to surrender the rights therefore you have certain responsibilities if you distribute copies of the "
        "software or if you modify it responsibilities to respect the freedom of others for example if you distribute copies of such a program whether gratis "
        "or for a fee you must pass on to the recipients the same freedoms that you received you must make sure that they too receive or can get the source "
        "code and you must show them these terms so they know their rights developers that use the gnu gpl protect your rights with two steps 1 assert "
        "copyright on the software and 2 offer you this license giving you legal permission to copy distribute and or modify it for the developers and authors "
        "protection the gpl clearly explains that there is no warranty for this free software for both users and authors sake the gpl requires that modified "
        "versions be marked as changed so that their problems will not be attributed erroneously to authors of previous versions some devices are designed to "
        "deny users access to install or run modified versions of the software inside them although the manufacturer can do so this is fundamentally "
        "incompatible with the aim of protecting users freedom to change the software the systematic pattern of such abuse occurs in the area of products for "
        "individuals to use which is precisely where it is most unacceptable therefore we have designed this version of the gpl to prohibit the practice for "
        "those products if such problems arise substantially in other domains we stand ready to extend this provision to those domains in future versions of "
        "the gpl as needed to protect the freedom of users finally every program is threatened constantly by software patents states should not allow patents "
        "to restrict development and use of software on general purpose computers but in those that do we wish to avoid the special danger that patents applied "
        "to a free program could make it effectively proprietary to prevent this the gpl assures that patents cannot be used to render the program non free the "
        "precise terms and conditions for copying distribution and modification follow",
    ),
    (
        "lgpl",
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended "
        "to guarantee your freedom to share and change free software to make sure the software is free for all its users this license the lesser general public "
        "license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use "
        "it you can use it too but we suggest you first think carefully about whether this license or the ordinary general public license is the better "
        "strategy to use in any particular case based on the explanations below when we speak of free software we are referring to freedom of use not price our "
        "general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge for this service if you "
        "wish that you receive source code or can get it if you want it that you can change the software and use pieces of it in new free programs and that you "
        "are informed that you can do these things to protect your rights we need to make restrictions that forbid distributors to deny you these rights or to "
        "ask you to surrender these rights these restrictions translate to certain responsibilities for you if you distribute copies of the library or if you "
        "modify it for example if you distribute copies of the library whether gratis or for a fee you must give the recipients all the rights that we gave you "
        "you must make sure that they too receive or can get the source code if you link other code with the library you must provide complete object files to "
        "the recipients so that they can relink them with the library after making changes to the library and recompiling it and you must show them these terms "
        "so they know their rights we protect your rights with a two step method 1 we copyright the library and 2 we offer you this license which gives you "
        "legal permission to copy distribute and or modify the library to protect each distributor we want to make it very clear that there is no warranty for "
        "the free library also if the library is modified by someone else and passed on the recipients should know that what they have is not the original "
        "version so that the original author s reputation will not be affected by problems that might be introduced by others finally software patents pose a "
        "constant threat to the existence of any free program we wish to make sure that a company cannot effectively restrict the users of a free program by "
        "obtaining a restrictive license from a patent holder therefore we insist that any patent license obtained for a version of the library must be "
        "consistent with the full freedom of use specified in this license most gnu software including some libraries is covered by the ordinary gnu general "
        "public license this license the gnu lesser general public license applies to certain designated libraries and is quite different from the ordinary "
        "general public license we use this license for certain libraries in order to permit linking those libraries into non free programs when a program is "
        "linked with a library whether statically or using a shared library the combination of the two is legally speaking a combined work a derivative of the "
        "original library the ordinary general public license therefore permits such linking only if the entire combination fits its criteria of freedom the "
        "lesser general public license permits more lax criteria for linking other code with the library we call this license the lesser general public license "
        "because it does less to protect the user s freedom than the ordinary general public license it also provides other free software developers less of an "
        "advantage over competing non free programs these disadvantages are the reason we use the ordinary general public license for many libraries however "
        "the lesser license provides advantages in certain special circumstances for example on rare occasions there may be a special need to encourage the "
        "widest possible use of a certain library so that it becomes a de facto standard to achieve this non free programs must be allowed to use the library a "
        "more frequent case is that a free library does the same job as widely used non free libraries in this case there is little to gain by limiting the "
        "free library to free software only so we use the lesser general public license in other cases permission to use a particular library in non free "
        "programs enables a greater number of people to use a large body of free software for example permission to use the gnu c library in non free programs "
        "enables many more people to use the whole gnu operating system as well as its variant the gnu linux operating system although the lesser general "
        "public license is less protective of the users freedom it does ensure that the user of a program that is linked with the library has the freedom and "
        "the wherewithal to run that program using a modified version of the library the precise terms and conditions for copying distribution and modification "
        "follow pay close attention to the difference between a work based on the library and a work that uses the library the former contains code derived "
        "from the library whereas the latter must be combined with the library in order to run gnu lesser general public license",
    ),
    (
        "cc0",
        "statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below "
        "upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work certain owners wish to "
        "permanently relinquish those rights to a work for the purpose of contributing to a commons of creative cultural and scientific works commons that the "
        "public can reliably and without fear of later claims of infringement build upon modify incorporate in other works reuse and redistribute as freely as "
        "possible in any form whatsoever and for any purposes including without limitation commercial purposes these owners may contribute to the commons to "
        "promote the ideal of a free culture and the further production of creative cultural and scientific works or to gain reputation or greater distribution "
        "for their work in part through the use and efforts of others for these and or other purposes and motivations and without any expectation of additional "
        "consideration or compensation the person associating cc0 with a work the affirmer to the extent that he or she is an owner of copyright and related "
        "rights in the work voluntarily elects to apply cc0 to the work and publicly distribute the work under its terms with knowledge of his or her copyright "
        "and related rights in the work and the meaning and intended legal effect of cc0 on those rights 1 copyright and related rights a work made available "
        "under cc0 may be protected by copyright and related or neighboring rights copyright and related rights copyright and related rights include but are "
        "not limited to the following i the right to reproduce adapt distribute perform display communicate and translate a work ii moral rights retained by "
        "the original author s and or performer s iii publicity and privacy rights pertaining to a person s image or likeness depicted in a work iv rights "
        "protecting against unfair competition in regards to a work subject to the limitations in paragraph 4 a below v rights protecting the extraction "
        "dissemination use and reuse of data in a work vi database rights such as those arising under directive 96 9 ec of the european parliament and of the "
        "council of 11 march 1996 on the legal protection of databases and under any national implementation thereof including any amended or successor version "
        "of such directive and vii other similar equivalent or corresponding rights throughout the world based on applicable law or treaty and any national "
        "implementations thereof 2 waiver to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully "
        "permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights and associated claims and "
        "causes of action whether now known or unknown including existing as well as future claims and causes of action in the work i in all territories "
        "worldwide ii for the maximum duration provided by applicable law or treaty including future time extensions iii in any current or future medium and "
        "for any number of copies and iv for any purpose whatsoever including without limitation commercial advertising or promotional purposes the waiver "
        "affirmer makes the waiver for the benefit of each member of the public at large and to the detriment of affirmer s heirs and successors fully "
        "intending that such waiver shall not be subject to revocation rescission cancellation termination or any other legal or equitable action to disrupt "
        "the quiet enjoyment of the work by the public as contemplated by affirmer s express statement of purpose 3 public license fallback should any part of "
        "the waiver for any reason be judged legally invalid or ineffective under applicable law then the waiver shall be preserved to the maximum extent "
        "permitted taking into account affirmer s express statement of purpose in addition to the extent the waiver is so judged affirmer hereby grants to each "
        "affected person a royalty free non transferable non sublicensable non exclusive irrevocable and unconditional license to exercise affirmer s copyright "
        "and related rights in the work i in all territories worldwide ii for the maximum duration provided by applicable law or treaty including future time "
        "extensions iii in any current or future medium and for any number of copies and iv for any purpose whatsoever including without limitation commercial "
        "advertising or promotional purposes the license the license shall be deemed effective as of the date cc0 was applied by affirmer to the work should "
        "any part of the license for any reason be judged legally invalid or ineffective under applicable law such partial invalidity or ineffectiveness shall "
        "not invalidate the remainder of the license and in such case affirmer hereby affirms that he or she will not i exercise any of his or her remaining "
        "copyright and related rights in the work or ii assert any associated claims and causes of action with respect to the work in either case contrary to "
        "affirmer s express statement of purpose 4 limitations and disclaimers a no trademark or patent rights held by affirmer are waived abandoned "
        "surrendered licensed or otherwise affected by this document b affirmer offers the work as is and makes no representations or warranties of any kind "
        "concerning the work express implied statutory or otherwise including without limitation warranties of title merchantability fitness for a particular "
        "purpose non infringement or the absence of latent or other defects accuracy or the present or absence of errors whether or not discoverable all to the "
        "greatest extent permissible under applicable law c affirmer disclaims responsibility for clearing rights of other persons that may apply to the work "
        "or any use thereof including without limitation any person s copyright and related rights in the work further affirmer disclaims responsibility for "
        "obtaining any necessary consents permissions or other rights required for any use of the work d affirmer understands and acknowledges that creative "
        "commons is not a party to this document and has no duty or obligation with respect to this cc0 or use of the work",
    ),
)
